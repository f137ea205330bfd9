"""Streaming forms of the timeline operators: windows with watermarks, sessions, and keyed state for change points."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Parquet files of a folder as they arrive; event time as a timestamp, with a watermark."""
    return spark.readStream.schema(schema).parquet(path).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(events: DataFrame, size: str, keys: list[str], time: str = "ts") -> DataFrame:
    return events.groupBy(F.window(time, size).alias("w"), *keys).agg(F.count("*").alias("n"))


def hopping(events: DataFrame, size: str, step: str, keys: list[str], time: str = "ts") -> DataFrame:
    return events.groupBy(F.window(time, size, step).alias("w"), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str, keys: list[str], time: str = "ts") -> DataFrame:
    return events.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))


def run_lengths(events: DataFrame, key: str = "user_id", label: str = "event_type", time: str = "ts", order: str = "event_id") -> DataFrame:
    """(key, label, run_length) of finished runs, as they end; the open run of each key is its state. Within a batch rows go by time, then ``order``."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values([time, order])
        out = []
        for x in rows[label]:
            if n and x == current:
                n += 1
            else:
                if n:
                    out.append((k[0], current, n))
                current, n = x, 1
        state.update((current, n))
        yield pd.DataFrame(out, columns=[key, "label", "run_length"])

    return events.groupBy(key).applyInPandasWithState(step, f"{key} long, label string, run_length long", "label string, n long", "append", GroupStateTimeout.NoTimeout)
