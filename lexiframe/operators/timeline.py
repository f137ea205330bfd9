"""Labelled timelines: change points, runs, segments, frames, windows. Keys are never gathered in one row; windows are partitioned by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def switches(df: DataFrame, keys: list[str], order: list[str], label: str, first: bool = True) -> DataFrame:
    """The rows at which the label changes, the first row included if ``first``."""
    before = F.lag(label).over(_by(keys, order))
    n = F.row_number().over(_by(keys, order))
    out = df.withColumn("_prev", before).withColumn("_n", n)
    changed = ~F.col(label).eqNullSafe(F.col("_prev"))
    return out.where(((F.col("_n") == 1) & F.lit(first)) | ((F.col("_n") > 1) & changed)).drop("_prev", "_n")


def runs(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """``df`` with run_id (from 1) and run_length of each row's run of equal labels."""
    w = _by(keys, order)
    new = F.when(F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    out = df.withColumn("_new", new)
    out = out.withColumn("run_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return out.withColumn("run_length", F.count("*").over(Window.partitionBy(*keys, "run_id")))


def sustained(df: DataFrame, keys: list[str], order: list[str], flag: str, least: int = 15, label: str | None = None, forced: Column | None = None) -> DataFrame:
    """Runs of a true flag shorter than ``least`` are cleared; where it survives, ``label`` is forced."""
    out = runs(df, keys, order, flag).withColumn("held", F.coalesce(F.col(flag), F.lit(False)) & (F.col("run_length") >= least))
    return out.withColumn("held_label", F.when(F.col("held"), forced).otherwise(F.col(label))) if label else out


def merge_segments(df: DataFrame, keys: list[str], start: str = "start_s", end: str = "end_s", label: str = "label", gap: float = 1e-3) -> DataFrame:
    """Adjacent segments of one label that touch within ``gap`` become one."""
    w = _by(keys, [start, end])
    joined = F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.abs(F.lag(end).over(w) - F.col(start)) < gap)
    out = df.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    out = out.withColumn("_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(*keys, "_id").agg(F.min(start).alias(start), F.max(end).alias(end), F.first(label).alias(label)).drop("_id")


def median3(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The median of each value and its neighbours; at the ends the value stands in for the missing neighbour."""
    w = _by(keys, order)
    three = F.array(F.coalesce(F.lag(value).over(w), F.col(value)), F.col(value), F.coalesce(F.lead(value).over(w), F.col(value)))
    return df.withColumn("median", F.element_at(F.array_sort(three), 2))


def best_window(df: DataFrame, keys: list[str], order: str, value: str, n: int, digits: int = 12) -> DataFrame:
    """For each key the earliest full window of ``n`` rows with the largest mean, of so many digits."""
    w = _by(keys, [order])
    ahead = w.rowsBetween(0, n - 1)
    out = df.select(*keys, order, F.round(F.avg(value).over(ahead), digits).alias("mean"), F.count("*").over(ahead).alias("_n")).where(F.col("_n") == n)
    return out.groupBy(*keys).agg(F.max_by(order, F.struct("mean", (-F.unix_micros(F.col(order).cast("timestamp"))).alias("t"))).alias("start"), F.max("mean").alias("mean")) if dict(df.dtypes)[order].startswith("timestamp") else out.groupBy(*keys).agg(F.max_by(order, F.struct("mean", (-F.col(order)).alias("t"))).alias("start"), F.max("mean").alias("mean"))


def majority(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The commonest label of each key; ties go to the least."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.max_by(label, F.struct("n", (-F.col(label)).alias("l"))).alias("label"), F.max("n").alias("votes"))


def segments_to_frames(segments: DataFrame, keys: list[str], rate: int = 16000, hop: int = 160, order: str = "seg") -> DataFrame:
    """(keys, frame_idx, label): the frames from a segment's start to before its end; where segments overlap, the later one (by ``order``) counts."""
    at = lambda c: F.floor(F.floor(F.col(c) * rate) / hop).cast("long")
    spread = segments.withColumn("_s", at("start_s")).withColumn("_e", at("end_s")).where("_e > _s")
    frames = spread.select(*keys, F.explode(F.sequence(F.col("_s"), F.col("_e") - 1)).alias("frame_idx"), "label", F.col(order).alias("_o"))
    return frames.groupBy(*keys, "frame_idx").agg(F.max_by("label", "_o").alias("label"))


def spread_windows(frames: DataFrame, windows: DataFrame, keys: list[str], size: int, default) -> DataFrame:
    """Each frame takes the label of the window ``floor(frame / size)``; frames without one the default."""
    at = frames.withColumn("win", F.floor(F.col("frame_idx") / size).cast("long"))
    return at.join(windows.select(*keys, "win", "label"), [*keys, "win"], "left").withColumn("label", F.coalesce("label", F.lit(default))).drop("win")


def hops(n: Column, win: int, hop: int, least_one: bool = False) -> Column:
    """Starts of the full windows over n samples."""
    last = F.floor((n - win) / hop).cast("long")
    some = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: k * hop)
    return F.when(n >= win, some).otherwise(F.array(F.lit(0).cast("long")) if least_one else F.array().cast("array<long>"))


def strides(seconds: Column, win: float = 5.0, stride: float = 30.0) -> Column:
    """Starts of windows of ``win`` seconds every ``stride`` seconds that end within the clip; none for a shorter one."""
    n = F.floor((seconds - win) / stride).cast("int")
    return F.when(seconds >= win, F.transform(F.sequence(F.lit(0), n), lambda k: k * F.lit(float(stride)))).otherwise(F.array().cast("array<double>"))


def alternate(df: DataFrame, duration: str, order: list[str], keys: list[str], pause: float = 0.3) -> DataFrame:
    """Start and end of items laid one after the other with a pause between."""
    w = _by(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col(duration) + pause).over(w), F.lit(0.0))
    return df.withColumn("start_s", start).withColumn("end_s", start + F.col(duration))


def crop(segments: DataFrame, offset: Column, length: Column) -> DataFrame:
    """Segments that overlap a crop, re-based to it; starts are held at 0, ends are not cut."""
    out = segments.where((F.col("end_s") - offset > 0) & (F.col("start_s") - offset < length))
    return out.withColumn("start_s", F.greatest(F.lit(0.0), F.col("start_s") - offset)).withColumn("end_s", F.col("end_s") - offset)
