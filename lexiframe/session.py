"""Session builder for local runs and tests; on a cluster the caller brings its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution, UTC and Arrow; the cluster's own settings are never overridden."""
    return (
        SparkSession.builder.master(os.environ.get("LEXIFRAME_MASTER", f"local[{cores}]"))
        .appName("lexiframe")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
