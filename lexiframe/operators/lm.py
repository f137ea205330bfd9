"""Interpolated Kneser-Ney trigram model as tables: counts, contexts, continuations, discounts; scoring by equi joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lm_tokens, shingles

BOS, EOS, N = "<s>", "</s>", 3
FLOOR = 1e-12


def padded(tokens: Column, n: int = N) -> Column:
    return F.concat(F.array_repeat(F.lit(BOS), n - 1), tokens, F.array(F.lit(EOS)))


@dataclass
class Model:
    """ngram(order, gram, c), context(h, order, types, c), cont(w, n), meta(order, d), and the denominator of continuation probabilities."""

    ngram: DataFrame
    context: DataFrame
    cont: DataFrame
    meta: DataFrame
    denominator: int


def ngrams(texts: DataFrame, text: str = "text", n: int = N) -> DataFrame:
    """(order, gram, c) of orders 1 to n, padding included. Grams are strings joined by blanks, which no token has."""
    padded_tokens = texts.select(padded(lm_tokens(F.coalesce(F.col(text), F.lit(""))), n).alias("t"))
    every = F.flatten(F.array(*[F.transform(shingles(F.col("t"), k), lambda g: F.array_join(g, " ")) for k in range(1, n + 1)]))
    grams = padded_tokens.select(F.explode(every).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("c")).withColumn("order", F.size(F.split("gram", " "))).select("order", "gram", "c")


def discounts(ngram: DataFrame) -> DataFrame:
    one, two = F.sum(F.when(F.col("c") == 1, 1).otherwise(0)), F.sum(F.when(F.col("c") == 2, 1).otherwise(0))
    return ngram.groupBy("order").agg(F.count("*").alias("types"), F.sum("c").alias("tokens"), F.coalesce(F.try_divide(one, one + 2 * two), F.lit(0.5)).alias("d"))


def fit(texts: DataFrame, text: str = "text") -> Model:
    grams = ngrams(texts, text)
    h = F.regexp_replace("gram", " ?[^ ]+$", "")
    w = F.regexp_extract("gram", "([^ ]+)$", 1)
    context = grams.where(F.col("order") > 1).groupBy(h.alias("h")).agg(F.count("*").alias("types"))
    counts = grams.select(F.col("gram").alias("h"), F.col("c").alias("ch"))
    context = context.join(counts, "h")
    cont = grams.where(F.col("order") == 2).groupBy(w.alias("w")).agg(F.count("*").alias("n"))
    total = grams.agg(F.coalesce(F.sum(F.when(F.col("order") == 2, F.col("c"))), F.lit(0)).alias("b"), F.coalesce(F.sum(F.when(F.col("order") == 1, 1)), F.lit(0)).alias("v")).first()
    return Model(grams, context, cont, discounts(grams), total.b + total.v + 1)


def probabilities(model: Model, queries: DataFrame) -> DataFrame:
    """``queries`` (w, h2: word before the last, h1: last word) with p. A history that was never seen is shortened without a back-off weight."""
    d = {r.order: r.d for r in model.meta.collect()}  # three rows
    one = model.context.select(F.col("h").alias("h1"), F.col("types").alias("t1"), F.col("ch").alias("c1"))
    two = model.context.select(F.col("h").alias("h"), F.col("types").alias("t2"), F.col("ch").alias("c2"))
    grams = model.ngram
    q = queries.withColumn("h", F.concat_ws(" ", "h2", "h1"))
    q = q.join(model.cont, "w", "left").join(one, "h1", "left").join(two, "h", "left")
    q = q.withColumn("g2", F.concat_ws(" ", "h1", "w")).join(grams.select(F.col("gram").alias("g2"), F.col("c").alias("k2")), "g2", "left")
    q = q.withColumn("g3", F.concat_ws(" ", "h", "w")).join(grams.select(F.col("gram").alias("g3"), F.col("c").alias("k3")), "g3", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    low = (zero("n") + 1) / F.lit(float(model.denominator))
    share = lambda k, c, t, dk, p: F.greatest(zero(k) - F.lit(dk), F.lit(0.0)) / F.col(c) + F.lit(dk) * zero(t) / F.col(c) * p
    bi = F.when(F.col("c1").isNotNull(), share("k2", "c1", "t1", d.get(2, 0.5), low)).otherwise(low)
    tri = F.when(F.col("c2").isNotNull(), share("k3", "c2", "t2", d.get(3, 0.5), bi)).otherwise(bi)
    return q.select(*queries.columns, tri.alias("p"))


def numbered(words: DataFrame, word: str = "w") -> DataFrame:
    """``words`` with ``id``, their place in order from 1: the words of each two-letter beginning are numbered by themselves, after those of all beginnings before it."""
    w = words.withColumn("_head", F.substring(word, 1, 2))
    heads = w.groupBy("_head").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # beginnings are few, however many words there are
    at = w.join(heads.select("_head", before.alias("_before")), "_head")
    return at.withColumn("id", (F.col("_before") + F.row_number().over(Window.partitionBy("_head").orderBy(word))).cast("int")).drop("_head", "_before")


def build_syllabus_lm(spark, extra_texts: DataFrame | None = None) -> Model:
    """The model of the built-in sentences and any further texts (text)."""
    from .dictionary import lecture_sentences

    texts = lecture_sentences(spark).select("text")
    return fit(texts if extra_texts is None else texts.unionByName(extra_texts.select("text")))


def log_prob(p: Column) -> Column:
    return F.log(F.greatest(p, F.lit(FLOOR)))


def score_sequences(model: Model, texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, n, score): log probability of each text with its end."""
    t = texts.select(*keys, padded(lm_tokens(F.coalesce(F.col(text), F.lit("")))).alias("t"))
    steps = t.select(*keys, F.explode(F.transform(F.sequence(F.lit(2), F.size("t") - 1), lambda i: F.struct(F.get(F.col("t"), i).alias("w"), F.get(F.col("t"), i - 2).alias("h2"), F.get(F.col("t"), i - 1).alias("h1")))).alias("x"))
    # equal steps are looked up once
    distinct = steps.groupBy(*keys, "x").agg(F.count("*").alias("m")).select(*keys, "m", "x.w", "x.h2", "x.h1")
    looked = probabilities(model, distinct.select("w", "h2", "h1").distinct())
    out = distinct.join(looked, ["w", "h2", "h1"])
    return out.groupBy(*keys).agg(F.sum("m").alias("n"), F.sum(F.col("m") * log_prob(F.col("p"))).alias("score"))


def logit_bias(model: Model, candidates: DataFrame, lam: float = 0.4, boosts: list[int] | None = None, k: int = 64) -> DataFrame:
    """``candidates`` (hyp, id, token, score, h2, h1) with the biased score: the k best of each hypothesis get lam times their log probability, boosted ids 2.0 once."""
    rank = F.row_number().over(Window.partitionBy("hyp").orderBy(F.desc("score"), "id"))
    piece = F.lower(F.replace("token", F.lit("Ġ"), F.lit("")))
    c = candidates.withColumn("rank", rank).withColumn("w", piece)
    fits = (F.col("rank") <= k) & F.col("token").isNotNull() & ~F.startswith("token", F.lit("<|")) & F.col("w").rlike(r"^\p{L}+$")
    c = c.withColumn("fits", F.coalesce(fits, F.lit(False)))
    scored = probabilities(model, c.where("fits").select("w", "h2", "h1").distinct())
    out = c.join(scored, ["w", "h2", "h1"], "left")
    boost = F.when(F.col("id").isin(boosts), 2.0).otherwise(0.0) if boosts else F.lit(0.0)
    return out.select("hyp", "id", "token", "score", (F.col("score") + F.when(F.col("fits"), F.lit(lam) * log_prob(F.col("p"))).otherwise(0.0) + boost).alias("biased"))
