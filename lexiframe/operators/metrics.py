"""Evaluation: confusion, F1, boundary F1, equal error rate, edit-distance rates, pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.signal import let, total


def confusion(df: DataFrame, truth: str, pred: str, labels: list[int]) -> DataFrame:
    """(truth, pred, n) for all pairs of the listed labels, zero cells kept."""
    counts = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(truth).cast("int").alias("truth"), F.col(pred).cast("int").alias("pred")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias("truth")).withColumn("pred", F.explode(F.array(*[F.lit(x) for x in labels])))
    return grid.join(counts, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def macro_f1(cells: DataFrame, present_only: bool = False) -> DataFrame:
    """The mean F1 over labels; a label without rows counts 0, or is left out if ``present_only``."""
    side = lambda c: F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0) if c == "tp" else F.col("n")
    rows = cells.select(F.col("truth").alias("label"), side("tp").alias("tp"), side("n").alias("actual"), F.lit(0).cast("long").alias("said"))
    cols = cells.select(F.col("pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("said"))
    per = rows.unionByName(cols).groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("actual").alias("actual"), F.sum("said").alias("said"))
    if present_only:
        per = per.where("actual + said > 0")
    return per.agg(F.avg(F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("actual") + F.col("said")), F.lit(0.0))).alias("macro_f1"))


def boundary_matches(pred: Column, truth: Column, tolerance: int) -> Column:
    """How many predicted boundaries, in order, find the nearest true one not yet taken within the tolerance; ties go to the earlier."""

    def step(acc: Column, p: Column) -> Column:
        free = F.filter(truth, lambda t: (F.abs(t - p) <= tolerance) & ~F.array_contains(acc["used"], t))
        near = F.array_min(F.transform(free, lambda t: F.struct(F.abs(t - p).alias("d"), t.alias("t"))))
        return F.struct(F.when(near.isNull(), acc["used"]).otherwise(F.concat(acc["used"], F.array(near["t"]))).alias("used"))

    first = F.struct(F.array().cast("array<bigint>").alias("used"))
    return F.aggregate(pred, first, step, lambda a: F.size(a["used"]).cast("long"))


def boundary_f1(df: DataFrame, keys: list[str], pred: str = "pred", truth: str = "truth", tolerance: int = 20) -> DataFrame:
    """Precision, recall and F1 of boundary lists; two empty lists agree, one empty one does not. Lists are of one clip each."""
    out = df.withColumn("matched", boundary_matches(F.col(pred), F.col(truth), tolerance))
    n, m = F.size(pred), F.size(truth)
    one = lambda c: F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(c)
    out = out.withColumn("precision", one(F.col("matched") / n)).withColumn("recall", one(F.col("matched") / m))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1", f1).select(*keys, "matched", "precision", "recall", "f1")


def eer_sweep(df: DataFrame, score: str, label: str, order: str) -> DataFrame:
    """Every threshold, best score first: false positive and false negative rates.

    A running sum over the whole table would put it into one task. The running sums are therefore over the ranges of a sampled range partitioning: sums of the ranges, then sums within
    each."""
    rows = df.select(F.col(order).alias("id"), F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("y")).where("score is not null and y is not null")
    parted = rows.repartitionByRange(F.desc("score"), F.asc("id")).withColumn("part", F.spark_partition_id())
    totals = parted.groupBy("part").agg(F.sum("y").alias("p1"), F.sum(1 - F.col("y")).alias("p0"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("p1").over(before), F.lit(0)).alias("b1"), F.coalesce(F.sum("p0").over(before), F.lit(0)).alias("b0"))
    size = totals.agg(F.sum("p1").alias("n1"), F.sum("p0").alias("n0"))
    w = Window.partitionBy("part").orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    out = parted.withColumn("c1", F.sum("y").over(w)).withColumn("c0", F.sum(1 - F.col("y")).over(w)).join(F.broadcast(base), "part")
    out = out.join(F.broadcast(size))  # one row
    fpr = (F.col("b0") + F.col("c0")) / F.greatest(F.lit(1), F.col("n0"))
    fnr = 1 - (F.col("b1") + F.col("c1")) / F.greatest(F.lit(1), F.col("n1"))
    rank = (F.col("b0") + F.col("b1") + F.col("c0") + F.col("c1")).cast("long")
    return out.select("id", "score", "y", rank.alias("rank"), fpr.alias("fpr"), fnr.alias("fnr"))


def eer(sweep: DataFrame) -> DataFrame:
    """The row before the first change of sign of fpr - fnr, else the one of least difference: (eer, threshold).

    fpr - fnr grows with rank, so that row is the last one with a negative difference before the first that is not; extrema find both without a sort."""
    d = F.col("fpr") - F.col("fnr")
    row = F.struct("rank", "fpr", "fnr", "score")
    pick = sweep.agg(F.max(F.when(d < 0, row)).alias("last"), F.max(F.when(d >= 0, 1)).alias("crosses"), F.min(F.struct(F.abs(d).alias("gap"), "rank", "fpr", "fnr", "score")).alias("near"))
    use = F.when(F.col("last").isNotNull() & F.col("crosses").isNotNull(), F.struct("last.fpr", "last.fnr", "last.score")).otherwise(F.struct("near.fpr", "near.fnr", "near.score"))
    return pick.select(use.alias("u")).select(((F.col("u.fpr") + F.col("u.fnr")) / 2).alias("eer"), F.col("u.score").alias("threshold"))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of token arrays: tokens become characters, then the built-in does it.

    A token that only one side has matches nothing, whichever it is, so that all of a side's share one character; only the tokens that both have need one
    each. Up to 1,111,000 of these have one; beyond, the row fails instead of being told wrong."""

    def distance(shared: Column) -> Column:
        place = lambda t: F.array_position(shared, t).cast("int")
        point = lambda k: F.when(k < 0xD000, k + 0x400).otherwise(k + 0x1000)  # noqa: E731  past the surrogates
        code = lambda t, own: let(place(t), lambda k: F.decode(F.unhex(F.lpad(F.hex(F.when(k == 0, own).otherwise(point(k))), 8, "0")), "UTF-32"))
        spell = lambda x, own: F.array_join(F.transform(x, lambda t: code(t, own)), "")
        told = F.levenshtein(spell(a, 0x21), spell(b, 0x22))
        return F.when(F.size(shared) <= 1_111_000, told).otherwise(F.raise_error(F.lit("too many different tokens that both sides have")).cast("int"))

    return let(F.array_intersect(a, b), distance)


def wer(ref: Column, hyp: Column) -> Column:
    """Word error rate."""
    return F.try_divide(edit_distance(ref, hyp).cast("double"), F.size(ref))


def cer(ref: Column, hyp: Column) -> Column:
    return F.try_divide(F.levenshtein(ref, hyp).cast("double"), F.length(ref))


def stats_pool(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """(keys, dim, mean, std): mean and sample deviation over rows, by dimension."""
    e = df.select(*keys, F.posexplode(vec).alias("dim", "v"))
    return e.groupBy(*keys, "dim").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.stddev_samp(F.col("v").cast("double")).alias("std"))


def attention_pool(df: DataFrame, keys: list[str], vec: str, score: Column) -> DataFrame:
    """(keys, dim, pooled): the mean weighted by the softmax of the scores over each key's rows."""
    s = df.withColumn("_s", score)
    top = s.groupBy(*keys).agg(F.max("_s").alias("_m"))
    e = s.join(top, keys).withColumn("_w", F.exp(F.col("_s") - F.col("_m"))).select(*keys, "_w", F.posexplode(vec).alias("dim", "v"))
    return e.groupBy(*keys, "dim").agg((F.sum(F.col("_w") * F.col("v").cast("double")) / F.sum("_w")).alias("pooled"))


def softmax(v: Column) -> Column:
    share = lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t))
    return let(F.array_max(v), lambda m: let(F.transform(v, lambda x: F.exp(x - m)), share))


def cross_entropy(logits: Column, label: Column, smoothing: float = 0.05) -> Column:
    """Loss of one row with label smoothing; null for an ignored (null) label."""
    p = F.transform(softmax(logits), lambda x: F.log(x))
    n = F.size(logits)
    mean = F.aggregate(p, F.lit(0.0), lambda s, x: s + x) / n
    return F.when(label.isNotNull(), -((1 - smoothing) * F.get(p, label.cast("int")) + smoothing * mean))


def multitask_loss(frame: Column, utterance: Column, alpha: float = 0.7) -> Column:
    """An aggregate: the mean loss of frames and that of utterances, ``alpha`` and 1 - ``alpha`` of it; nulls (ignored labels) count in neither mean."""
    return alpha * F.avg(frame) + (1 - alpha) * F.avg(utterance)


def mean_boundary_f1(df: DataFrame, keys: list[str], pred: str = "pred", truth: str = "truth", tolerance: int = 20) -> DataFrame:
    """The mean of the clips' boundary F1, each clip counting once."""
    return boundary_f1(df, keys, pred, truth, tolerance).agg(F.avg("f1").alias("mean_f1"), F.count("*").alias("clips"))


def loss_log(df: DataFrame, keys: list[str], loss: str) -> DataFrame:
    """(keys, rows, mean): one row a step or epoch."""
    return df.groupBy(*keys).agg(F.count(loss).alias("rows"), F.avg(loss).alias("mean"))


def error_report(ref: Column, hyp: Column, words, languages: Column) -> Column:
    """A transcript's report as JSON: word and character error rates; where several languages were heard, the rates by language are null, and a note says what they need."""
    split = F.size(F.array_distinct(languages)) > 1
    base = [wer(words(ref), words(hyp)).alias("WER_overall"), cer(ref, hyp).alias("CER_overall")]
    none = [F.lit(None).cast("double").alias("WER_en_segments"), F.lit(None).cast("double").alias("WER_hi_segments"), F.lit("rates by language need a reference with times").alias("segment_split_note")]
    return F.when(split, F.to_json(F.struct(*base, *none), {"ignoreNullFields": "false"})).otherwise(F.to_json(F.struct(*base)))
