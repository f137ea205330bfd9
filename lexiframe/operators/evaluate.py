"""Compositions: a scored timeline against its segments, a probe's best window, chunked transcription, corpus preparation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics, timeline


def predict_frames(frames: DataFrame, keys: list[str], scores: str, level: str, silence: float = -75.0, least: int = 15, silent_label: int = 2) -> DataFrame:
    """(keys, frame_idx, label): the best score, smoothed over three frames, and silence wherever the level stays below the gate for ``least`` frames."""
    from .scorer import argmax

    best = frames.withColumn("label", argmax(F.col(scores))).withColumn("quiet", F.col(level) < silence)
    smooth = timeline.median3(best, keys, ["frame_idx"], "label").drop("label").withColumnRenamed("median", "label")
    held = timeline.sustained(smooth, keys, ["frame_idx"], "quiet", least, "label", F.lit(silent_label))
    return held.select(*keys, "frame_idx", F.col("held_label").alias("label"))


def evaluate(predicted: DataFrame, segments: DataFrame, keys: list[str], labels: list[int], rate: int = 16000, hop: int = 160) -> tuple[DataFrame, DataFrame]:
    """(confusion cells, macro F1) of predicted frames against segments (keys, seg, start_s, end_s, label); frames outside segments are left out."""
    truth = timeline.segments_to_frames(segments, keys, rate, hop).withColumnRenamed("label", "truth")
    both = predicted.withColumnRenamed("label", "pred").join(truth, [*keys, "frame_idx"])
    cells = metrics.confusion(both, "truth", "pred", labels)
    return cells, metrics.macro_f1(cells)


def probe_windows(probes: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The window of so many probes (t, p_en, p_hi) with the largest share of HI; ties go to the earliest, and to the first probe if none has any."""
    hits = probes.withColumn("hi", F.when(F.col("p_hi") > F.col("p_en"), 1.0).otherwise(0.0))
    return timeline.best_window(hits, keys, "t", "hi", rows)


def chunks(clips: DataFrame, seconds: float, keep_tail: bool = True, least_s: float = 0.0) -> DataFrame:
    """(clip_id, chunk, sr, samples): tumbling pieces of clips; the tail is kept if it has ``least_s`` seconds."""
    n = F.size("samples")
    size = F.floor(F.col("sr") * seconds).cast("int")
    parts = clips.select("clip_id", "sr", "samples", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / size).cast("int") - 1))).alias("chunk"))
    cut = parts.withColumn("samples", F.slice("samples", F.col("chunk") * F.floor(F.col("sr") * seconds).cast("int") + 1, F.floor(F.col("sr") * seconds).cast("int")))
    full = F.size("samples") >= (F.floor(F.col("sr") * least_s) if keep_tail else F.floor(F.col("sr") * seconds))
    return cut.where(full & (F.size("samples") > 0))


def transcribe(clips: DataFrame, scorer: Callable[[DataFrame], DataFrame], seconds: float = 28.0) -> DataFrame:
    """(clip_id, text): 28-second chunks, tails under a second dropped, scored (clip_id, chunk, text), and joined by blanks in order."""
    said = scorer(chunks(clips, seconds, least_s=1.0))
    rows = said.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("xs"))
    return rows.select("clip_id", F.array_join(F.filter(F.transform("xs", lambda x: F.trim(x["text"])), lambda x: x != ""), " ").alias("text"))


def seconds_per_label(segments: DataFrame) -> DataFrame:
    return segments.groupBy("label").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("seconds"))


def prepare(clips: DataFrame, n: int, least_s: float = 3.0, seed: int | None = 0) -> DataFrame:
    """The first n clips of ``least_s`` seconds or more, in an order drawn by the seed, or by name without one."""
    order: Column = F.xxhash64("clip_id", F.lit(seed)) if seed is not None else F.col("clip_id")
    return clips.where(F.size("samples") / F.col("sr") >= least_s).orderBy(order, "clip_id").limit(n)


def round_robin(items: DataFrame, order: list[str], slots: int, keys: list[str]) -> DataFrame:
    return items.withColumn("slot", F.pmod(F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1, F.lit(slots)))
