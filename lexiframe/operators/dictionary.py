"""Dictionary translation and the composition of dictionary entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon, tables
from ..functions.text import split_words


#: Entries of a dictionary that goes along as a map at most.
SMALL = 1000


def seed_entries(spark: SparkSession) -> DataFrame:
    """(ord, key, ol, deva, hi, gloss) of the seed dictionary."""
    rows = [(i, *line.split("\t")) for i, line in enumerate(lexicon.SEED_TERMS.strip("\n").split("\n"))]
    df = spark.createDataFrame(rows, "ord int, key string, ol string, deva string, hi string")
    return df.withColumn("gloss", F.col("key"))


def lecture_sentences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lexicon.LECTURE_SENTENCES.strip("\n").split("\n"))), "sent_id int, text string")


def compounds(entries: DataFrame, modifiers: DataFrame, heads: DataFrame, total: int = 500) -> DataFrame:
    """``entries`` (ord, key, ol, deva, hi, gloss) and compounds of modifier and head, in modifier-major order, up to ``total``.

    Existing keys and pairs with an unknown part are passed over. modifiers and heads: (ord, key), fixed lists."""
    m = F.broadcast(modifiers.select(F.col("ord").alias("mo"), F.col("key").alias("m")))
    pairs = heads.select(F.col("ord").alias("ho"), F.col("key").alias("h")).crossJoin(m)  # two fixed lists of dozens
    part = lambda p: entries.select(F.col("key").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("ol", "deva", "hi")])
    both = pairs.join(part("m"), "m").join(part("h"), "h").withColumn("key", F.concat_ws("_", "m", "h"))
    new = both.join(entries.select("key"), "key", "left_anti")
    n = entries.count()
    new = new.orderBy("mo", "ho").limit(max(0, total - n))
    dash = lambda c: F.concat_ws("-", f"m_{c}", f"h_{c}").alias(c)
    made = new.select((F.lit(n) + F.col("mo") * 1000 + F.col("ho")).cast("int").alias("ord"), "key", dash("ol"), dash("deva"), F.concat_ws(" ", "m_hi", "h_hi").alias("hi"), F.replace("key", F.lit("_"), F.lit(" ")).alias("gloss"))
    return entries.select(*made.columns).unionByName(made)


def full_dictionary(spark: SparkSession) -> DataFrame:
    lists = lambda xs: spark.createDataFrame(list(enumerate(xs)), "ord int, key string")
    return compounds(seed_entries(spark), lists(tables.MODIFIERS), lists(tables.HEADS))


def lookup_key(raw: Column) -> Column:
    return F.lower(F.regexp_replace(raw, "^[.,!?;:]+|[.,!?;:]+$", ""))


def translate(texts: DataFrame, entries: DataFrame, keys: list[str], text: str = "text", target: str = "ol") -> DataFrame:
    """(keys, translation): a token that is in the dictionary without its outer punctuation is replaced as a whole, others stay. Of entries with one key the least target counts.

    A dictionary of up to SMALL entries goes along as a map, and nothing is dealt out. A larger one is joined, which deals out every word."""
    one = entries.groupBy("key").agg(F.min(target).alias("t"))
    few = one.limit(SMALL + 1).collect()  # SMALL rows and one at most
    if len(few) <= SMALL:
        if not few:
            return texts.select(*keys, F.array_join(split_words(F.coalesce(F.col(text), F.lit(""))), " ").alias("translation"))
        known = F.create_map(*[F.lit(x) for r in few for x in (r.key, r.t)])
        said = F.transform(split_words(F.coalesce(F.col(text), F.lit(""))), lambda w: F.coalesce(F.try_element_at(known, lookup_key(w)), w))
        return texts.select(*keys, F.array_join(said, " ").alias("translation"))
    words = texts.select(*keys, F.posexplode(split_words(F.coalesce(F.col(text), F.lit("")))).alias("pos", "raw"))
    hits = words.withColumn("key", lookup_key(F.col("raw"))).join(one, "key", "left")
    told = hits.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("t", "raw").alias("w")))), lambda x: x["w"]), " ").alias("translation"))
    return texts.select(*keys).join(told, keys, "left").withColumn("translation", F.coalesce("translation", F.lit("")))
