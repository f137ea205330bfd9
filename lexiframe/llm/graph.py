"""Connected components by alternating large-star and small-star, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Every node gets the least of its neighbours and itself by a pre-aggregated minimum, then meets its edges again in a
    join, which adaptive execution can split; a node's neighbours are never gathered in one row."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    hop = both.join(least, "u")
    out = hop.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else hop.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(spark: SparkSession, edges: DataFrame, stage: Stage | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: integers), root being the least node of its component.

    Loops and repeated edges are ignored; rows with a null end are dropped, as they link nothing; no edges give no rows. Every round is
    written to the shared folder, so that a lost executor costs one round at most."""
    stage = stage or Stage(spark, "components")
    now = stage.table(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    seen = None
    while True:
        new = stage.table(_star(_star(now, True), False))
        stage.drop(now)
        now = new
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (state.n, state.s) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = (state.n, state.s)
