"""Mixing sources to target weights: hierarchical budgets and seeded token prefixes, in DataFrame expressions alone.

A budget of tokens goes down a tree (domain, language, source, say) by the weights of the children. A child can take its epochs' worth of
tokens at most; what it cannot take goes to its siblings by their weights, and only what all of them cannot take goes to the parent's
siblings, since a parent is never given more than its subtree can take. For one parent of budget b, children of weight w and capacity c
get min(c, w * level), where the level is the largest of (b - capacities before) / (weights from here on), in order of c / w.

A leaf's budget is whole epochs and a prefix of one more, in an order drawn by seed and epoch. The prefix needs no ordered pass over a
leaf, which may hold a third of all rows: token sums of 4096 hash ranges give the range in which the prefix ends, and rows are ordered within that range alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SEED, MAX_EPOCHS, SHARE = 17, 3, 0.6
#: Leaf tables of so many rows at most are broadcast (about 100 bytes each); larger ones are joined by shuffle.
SMALL = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def leading(text: Column, n: Column) -> Column:
    """The first ``n`` words of a text, with the white space before each."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), n.cast("int")), "")


def weight(level: Column, weights: dict[str, int], other: int) -> Column:
    return reduce(lambda out, kv: F.when(level == kv[0], kv[1]).otherwise(out), sorted(weights.items()), F.lit(other)).cast("long")


def allocate(leaves: DataFrame, levels: list[str], weights: list[Column], budget: Column) -> DataFrame:
    """``leaves`` (levels..., cap) with the column ``given``: the tokens that each leaf gets of ``budget``."""
    out = leaves.withColumn("given", budget.cast("double"))
    for k, w in enumerate(weights):
        nodes = out.withColumn("w", w).where("w > 0").groupBy(*levels[: k + 1], "w").agg(F.sum("cap").alias("c"), F.first("given").alias("b"))
        above = [F.col(x) for x in levels[:k]] or [F.lit(0)]
        by = Window.partitionBy(*above).orderBy(F.col("c") / F.col("w"), levels[k])
        prior = by.rowsBetween(Window.unboundedPreceding, -1)
        ahead = by.rowsBetween(0, Window.unboundedFollowing)
        level = (F.col("b") - F.coalesce(F.sum("c").over(prior), F.lit(0))) / F.sum("w").over(ahead)
        nodes = nodes.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy(*above)))
        nodes = nodes.select(*levels[: k + 1], F.least(F.col("c").cast("double"), F.col("w") * F.greatest(F.col("level"), F.lit(0.0))).alias("given"))
        out = out.drop("given").join(nodes, levels[: k + 1])
    return out


def mix(spark: SparkSession, docs: DataFrame, levels: list[str], weights: list[Column], share: float = SHARE, budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, levels..., n_tokens, epochs, cut, taken): rows of which something is taken, ``epochs`` times whole and ``cut`` leading tokens once more.

    ``with_text`` adds ``text``: whole where a row is taken whole at least once, else its first ``cut`` tokens (words without ASCII white space) as they stand.

    ``budget`` tokens, or ``share`` of all. Level values that are null count as the empty string. Rows without tokens (null or empty texts) carry nothing and
    are left out, as are nodes of weight 0. Rows that repeat an id are taken each; alike ones tie, and count as equal. An empty table gives an empty one."""
    stage = C.Stage(spark, "mix")
    n = tokens if tokens is not None else words(F.col(text_col))
    texts = [F.col(text_col).alias("_text")] if with_text else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in levels], n.alias("n_tokens"), *texts)
    rows = stage.table(rows.where("n_tokens > 0"))
    sizes = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("size")).withColumn("cap", F.col("size") * max_epochs)
    total = F.lit(budget) if budget is not None else F.floor(F.lit(share) * F.lit(rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]))
    given = allocate(sizes, levels, weights, total)
    leaves = given.select(*levels, F.expr("cast(floor(floor(given) / size) as int)").alias("epochs"), F.expr("cast(floor(given) - size * floor(floor(given) / size) as long)").alias("rest"))
    leaves = stage.table(leaves)
    leaves_in = F.broadcast(leaves) if leaves.count() <= SMALL else leaves
    keyed = rows.join(leaves_in, levels).withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    keyed = keyed.withColumn("range", F.substring("key", 1, 3))
    sums = keyed.groupBy(*levels, "rest", "range").agg(F.sum("n_tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*levels).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = stage.table(sums.withColumn("before", before).where("before < rest AND before + t >= rest").select(*levels, F.col("range").alias("end"), "before"))
    ends_in = F.broadcast(ends) if ends.count() <= SMALL else ends
    keyed = keyed.join(ends_in, levels, "left")
    whole = keyed.where("`range` < end").withColumn("cut", F.col("n_tokens"))
    none = keyed.where("end IS NULL OR `range` > end").withColumn("cut", F.lit(0).cast("long"))
    order = Window.partitionBy(*levels).orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = keyed.where("`range` = end").withColumn("cut", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - F.col("before") - F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))).cast("long"))
    out = whole.unionByName(none).unionByName(edge).withColumn("taken", (F.col("epochs") * F.col("n_tokens") + F.col("cut")).cast("long"))
    if with_text:
        texts = [F.when((F.col("epochs") > 0) | (F.col("cut") == F.col("n_tokens")), F.col("_text")).otherwise(leading(F.col("_text"), F.col("cut"))).alias("text")]
    return out.where("taken > 0").select("doc_id", *levels, "n_tokens", "epochs", "cut", "taken", *texts)


#: The query's tree: four domains by the number in a source's name, then language, then source.
DOMAIN = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG = {"en": 5, "de": 2, "fr": 2, "es": 1}


def with_domain(docs: DataFrame) -> DataFrame:
    digits = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]{1,9})", 1)
    return docs.withColumn("domain", F.concat(F.lit("d"), F.when(digits == "", F.lit(3)).otherwise(F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})', 1) as int)") % 4).cast("string")))


def corpus_mix(spark: SparkSession, docs: DataFrame, with_text: bool = False) -> DataFrame:
    levels = ["domain", "lang", "source"]
    return mix(spark, with_domain(docs), levels, [weight(F.col("domain"), DOMAIN, 1), weight(F.col("lang"), LANG, 1), F.lit(1).cast("long")], with_text=with_text)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_mix(spark, C.read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def _level(k: int, cols: str, above: str, w: str, given: str) -> str:
    on = " AND ".join(f"g.{c} = r.{c}" for c in above.split(", ")) if above else "TRUE"
    return f"""n{k} AS (SELECT {cols}, {w} AS w, sum(cap) AS c FROM sizes GROUP BY {cols}),
j{k} AS (SELECT r.*, g.given AS b FROM n{k} r JOIN {given} g ON {on}),
l{k} AS (SELECT *, (b - coalesce(sum(c) OVER (PARTITION BY {above or '0'} ORDER BY c / w, {cols.split(', ')[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(w) OVER (PARTITION BY {above or '0'} ORDER BY c / w, {cols.split(', ')[-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lv FROM j{k}),
g{k} AS (SELECT {cols}, least(c::DOUBLE, w * greatest(max(lv) OVER (PARTITION BY {above or '0'}), 0)) AS given FROM l{k})"""


#: The same budgets and prefixes, with the prefix as one ordered sum over each leaf.
OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    'd' || CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})', 1) = '' THEN 3 ELSE regexp_extract(source, '([0-9]{{1,9}})', 1)::INT % 4 END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
r AS (SELECT * FROM d WHERE n_tokens > 0),
sizes AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS size, (3 * sum(n_tokens))::BIGINT AS cap FROM r GROUP BY ALL),
g0 AS (SELECT floor(0.6::DOUBLE * sum(n_tokens)::DOUBLE) AS given FROM r),
{_level(1, "domain", "", "CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END", "g0")},
{_level(2, "domain, lang", "domain", "CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END", "g1")},
{_level(3, "domain, lang, source", "domain, lang", "1", "g2")},
q AS (SELECT s.*, floor(g.given)::BIGINT AS given FROM sizes s JOIN g3 g USING (domain, lang, source)),
e AS (SELECT *, (given // size)::INT AS epochs, given - size * (given // size) AS rest FROM q),
k AS (SELECT r.*, e.epochs, e.rest, md5('17:' || e.epochs || ':' || r.doc_id) AS key FROM r JOIN e USING (domain, lang, source)),
c AS (SELECT *, greatest(0, least(n_tokens, rest - coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS cut FROM k)
SELECT doc_id, domain, lang, source, n_tokens, epochs, cut, (epochs * n_tokens + cut)::BIGINT AS taken FROM c WHERE epochs * n_tokens + cut > 0
"""
