"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, and mixing to target weights.

Every stage reads what the one before has written. The first three leave documents out, the fourth masks personal data in the texts of all, and the
last returns the documents that the mixture takes, with their texts, how often and how far.

All but the last return the columns of ``documents`` as they are and leave other columns out. Any column may be null. Null and empty texts are neither toxic nor
duplicates nor contaminated and hold no personal data; the mixture, which takes tokens, leaves them out. Rows that share an id are judged each by its text; of rows equal in
all columns near duplicates keep one. Texts of any length are read whole. An empty table gives an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.llm import common, decontam, mixing, near_dedup, pii, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts to be toxic go. Where no label is given to learn from, all stay."""
    scored = toxicity.toxicity(spark, docs, common.read(spark, sf_dir, "labels", "doc_id", "toxic"), keep=COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def _keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row: its id, or where that is null or repeated, a hash of the row beyond usual ids. Of equal rows one stays."""
    docs, stage = docs.select(*COLUMNS), common.Stage(spark, "rows")
    again = stage.table(docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id"))
    alone = docs.withColumn("key", F.col("doc_id").cast("long"))
    if again.isEmpty():
        return alone
    known = again.where("doc_id IS NOT NULL")
    known = F.broadcast(known) if known.count() <= common.SMALL_IDS else known
    odd = docs.where("doc_id IS NULL").unionByName(docs.join(known, "doc_id", "left_semi").select(*COLUMNS)).dropDuplicates()
    far = F.shiftrightunsigned(F.xxhash64(*[F.struct(F.col(c), F.col(c).isNull()) for c in COLUMNS]), 2).bitwiseOR(F.lit(1 << 62))
    alone = alone.where("doc_id IS NOT NULL").join(known, "doc_id", "left_anti")
    return stage.table(alone.select(*COLUMNS, "key").unionByName(odd.withColumn("key", far)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8 or more. Rows without an id, or that share one, are told apart by a key."""
    rows = _keyed(spark, docs)
    found = near_dedup.near_duplicates(spark, rows, near_dedup.Params(width=5, threshold=(80, 100)), id_col="key")
    kept = common.Stage(spark, "kept").table(found.where("kept").select(F.col("doc_id").alias("key")))
    return common.only(rows, kept, "key").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item as long as a window go, however long they are; for items that are shorter, and may occur by chance, the
    operator's rule holds: a twentieth of a document's words."""
    hits = decontam.benchmark_hits(docs, common.read(spark, sf_dir, "benchmark", "item_id", "text"), keep=COLUMNS)
    lengths = F.transform("hits", lambda x, i: F.when(i % 2 == 1, x - F.get("hits", i - 1)).otherwise(0))
    told = decontam.report(hits.withColumn("passage", F.exists(lengths, lambda n: n >= decontam.WIDTH)), (*COLUMNS, "passage"))
    return told.where("NOT contaminated AND NOT passage").select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; spans of personal data are masked by kind, and n_chars is that of the masked text. A null text stays null."""
    found = pii.personal_data(spark, docs.select("doc_id", "text", "lang", "source"), keep=("text", "lang", "source"))
    masked = found.withColumn("text", F.when(F.col("text").isNotNull(), pii.redact(found, F.col("text"))))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epochs, cut, taken, text, n_chars) of the documents that the mixture takes: ``epochs`` times whole, and ``cut`` leading tokens
    once more; the text of one that is never taken whole is cut there. A null source or language counts as the empty string."""
    return mixing.corpus_mix(spark, docs, with_text=True).withColumn("n_chars", F.length("text").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]

#: Learned scores are not expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage, docs = common.Stage(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        old, docs = docs, stage.table(step(spark, docs, sf_dir))
        stage.drop(old)
    return STAGES[-1][1](spark, docs, sf_dir)
