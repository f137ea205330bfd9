"""Synthetic labelled timelines and clips, drawn by a hash of seed, clip and step, so that they do not depend on partitions. Folds over a bounded number of steps a clip."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = "array<struct<start_s:double,end_s:double,label:string>>"


def uniform(seed: int, *parts: Column) -> Column:
    """In [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _segment(start: Column, end: Column, label: Column) -> Column:
    return F.struct(start.cast("double").alias("start_s"), end.cast("double").alias("end_s"), label.alias("label"))


def _state(t: Column, segs: Column) -> Column:
    return F.struct(t.cast("double").alias("t"), segs.alias("segs"))


def tone_segments(clip: Column, seed: int = 0, seconds: float = 5.0) -> Column:
    """Segments of 0.4 to 1.2 seconds, EN or HI, until less than 0.3 seconds are left."""

    def step(s: Column, k: Column) -> Column:
        end = F.least(F.lit(seconds), s["t"] + 0.4 + 0.8 * uniform(seed, clip, k, F.lit("d")))
        label = F.when(uniform(seed, clip, k, F.lit("l")) < 0.5, "EN").otherwise("HI")
        return F.when(s["t"] < seconds - 0.3, _state(end, F.concat(s["segs"], F.array(_segment(s["t"], end, label))))).otherwise(s)

    steps = F.sequence(F.lit(1), F.lit(math.ceil(seconds / 0.4)))
    return F.aggregate(steps, _state(F.lit(0.0), F.array().cast(SEGMENT)), step, lambda s: s["segs"])


def tones(segments: Column, clip: Column, seed: int = 0, seconds: float = 5.0, rate: int = 16000) -> Column:
    """Samples: a tone and its octave, 200 Hz for EN and 310 Hz for HI, with uniform noise of deviation 0.05."""
    n = int(seconds * rate)

    def sample(i: Column) -> Column:
        t = i / float(rate)
        own = F.element_at(F.filter(segments, lambda s: s["start_s"] <= t), -1)
        phase = 2 * math.pi * F.when(own["label"] == "EN", 200.0).otherwise(310.0) * (t - own["start_s"])
        noise = (uniform(seed, clip, i, F.lit("n")) - 0.5) * (0.05 * math.sqrt(12))
        return F.when(t < F.element_at(segments, -1)["end_s"], 0.3 * F.sin(phase) + 0.1 * F.sin(2 * phase) + noise).otherwise(0.0).cast("float")

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), sample)


def synthetic_clips(spark: SparkSession, n: int = 64, seed: int = 0, seconds: float = 5.0, rate: int = 16000) -> DataFrame:
    """(clip_id, sr, segments, samples)."""
    c = spark.range(n).select(F.format_string("synth_%04d", F.col("id")).alias("clip_id"), F.lit(rate).alias("sr"))
    c = c.withColumn("segments", tone_segments(F.col("clip_id"), seed, seconds))
    return c.withColumn("samples", tones(F.col("segments"), F.col("clip_id"), seed, seconds, rate))


def alternating_timeline(durations: Column, target_s: float = 120.0, pause_s: float = 0.3) -> Column:
    """EN and HI in turn, taken from a pool of durations in order, over and over, each cut to min(8, max(3, 10 - t mod 10)) seconds and followed by a pause."""
    n = F.size(durations)

    def step(s: Column, k: Column) -> Column:
        most = F.least(F.lit(8.0), F.greatest(F.lit(3.0), 10 - s["t"] % 10))
        end = s["t"] + F.least(most, F.get(durations, F.pmod(F.floor(k / 2).cast("int"), n)))
        label = F.when(k % 2 == 0, "EN").otherwise("HI")
        more = F.concat(s["segs"], F.array(_segment(s["t"], end, label), _segment(end, end + pause_s, F.lit("SIL"))))
        return F.when(s["t"] < target_s, _state(end + pause_s, more)).otherwise(s)

    steps = F.sequence(F.lit(0), F.lit(math.ceil(target_s / pause_s)))
    return F.when(n > 0, F.aggregate(steps, _state(F.lit(0.0), F.array().cast(SEGMENT)), step, lambda s: s["segs"])).otherwise(F.array().cast(SEGMENT))


def mixed_timeline(clip: Column, durations: Column, target_s: float = 30.0, seed: int = 0) -> Column:
    """A silence of 0.2 to 0.5 s, then runs of one to three utterances a language, with 0.1 to 0.25 s between utterances and 0.3 to 0.6 s more between runs.

    A step is one utterance; the state knows how many of the run are left. The last run is finished beyond the target."""
    n = F.size(durations)
    u = lambda k, what: uniform(seed, clip, k, F.lit(what))
    state = lambda t, segs, lang, left: F.struct(t.cast("double").alias("t"), segs.alias("segs"), lang.alias("lang"), left.cast("int").alias("left"))
    length = lambda k: 1 + F.floor(3 * u(k, "run"))
    zero = F.lit(0)
    first = 0.2 + 0.3 * u(zero, "head")
    start = state(first, F.array(_segment(F.lit(0.0), first, F.lit("SIL"))), F.when(u(zero, "lang") < 0.5, "EN").otherwise("HI"), length(zero))

    def step(s: Column, k: Column) -> Column:
        end = s["t"] + F.get(durations, F.floor(u(k, "pick") * n).cast("int"))
        rest = end + 0.1 + 0.15 * u(k, "gap")
        over = rest + 0.3 + 0.3 * u(k, "pause")
        said = F.concat(s["segs"], F.array(_segment(s["t"], end, s["lang"]), _segment(end, rest, F.lit("SIL"))))
        last = s["left"] <= 1
        new = state(F.when(last, over).otherwise(rest), F.when(last, F.concat(said, F.array(_segment(rest, over, F.lit("SIL"))))).otherwise(said), F.when(last, F.when(s["lang"] == "EN", "HI").otherwise("EN")).otherwise(s["lang"]), F.when(last, F.when(over < target_s, length(k)).otherwise(0)).otherwise(s["left"] - 1))
        return F.when(s["left"] > 0, new).otherwise(s)

    steps = F.sequence(F.lit(1), F.lit(math.ceil(target_s / 0.1) + 3))
    return F.when(n > 0, F.aggregate(steps, start, step, lambda s: s["segs"])).otherwise(F.array().cast(SEGMENT))
