"""Personal data by weak supervision, in DataFrame expressions alone.

Candidates are the matches of fixed patterns, failing ones included, and of looser patterns. Four labelers vote on each: its form (checksum,
octets, digit count), a gazetteer (mail hosts and endings, card issuers, dialling codes, routable addresses), the words before it, and how
it is set off from its surroundings. How often each pattern of votes occurs, counted over all documents, is a table of at most 6 x 16
rows; expectation-maximisation over that table (two classes, conditionally independent votes) estimates what each labeler is worth, and its
posteriors train the final span classifier, a logistic model of votes, kind and form-context agreement. Both are folds over that one array. Matches of the fixed
patterns are always reported; the classifier decides on the rest.

Patterns are possessive and anchored by look-behind, so that long runs cost linear time and no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
KINDS = list(BASE)
CONTEXT = {"email": "mail|contact|write", "ip": r"\bip\b|address|host|server", "card": "card|visa|credit|payment|account", "phone": "phone|call|tel|mobile|fax|contact"}
GAZETTEER = {"email": r"(?i)mail|example|\.(?:com|org|net|edu|de|fr|es|io)$", "ip": r"^(?!0|127\.|255\.)", "card": "^(?:3[47]|4|5[1-5]|6)", "phone": r"^\+(?:1|33|34|44|49)\b|^\(?[2-9]"}
LABELERS = 4
STEPS, THRESHOLD = 25, 0.9
_SPAN = "array<struct<kind:string,start:long,end:long,text:string>>"


def spans_of(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost, non-overlapping matches with code point offsets: the pieces between matches give the distances."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.lit(None).cast(_SPAN)
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc, x):
        s = acc["at"] + F.length(x["between"])
        e = s + F.length(x["found"])
        return F.struct(e.cast("long").alias("at"), F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), s.cast("long").alias("start"), e.cast("long").alias("end"), x["found"].alias("text")))).alias("out"))

    pairs = F.zip_with(found, F.slice(between, 1, F.greatest(F.lit(1), F.size(found))), lambda f, b: F.struct(f.alias("found"), b.alias("between")))
    return F.coalesce(F.when(text.rlike(pattern), F.aggregate(pairs, first, step, lambda a: a["out"])), empty, F.array().cast(_SPAN))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    n = F.length(d)
    value = lambda i: F.substring(F.reverse(d), i, 1).cast("int") if isinstance(i, int) else F.ascii(F.reverse(d).substr(i, F.lit(1))) - 48
    twice = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, twice(value(i))).otherwise(value(i)))
    return total % 10 == 0


def valid(kind: Column, s: Column) -> Column:
    """What a match of a fixed pattern must hold."""
    d = _digits(s)
    octet = lambda x: F.length(F.regexp_replace(x, "^0+(?=.)", "")) <= 3
    ip = F.forall(F.split(s, r"\."), lambda x: octet(x) & (F.right(x, F.lit(3)).cast("int") <= 255))
    return F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "card", F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)).otherwise(F.length(d).between(8, 15))


def _by_kind(kind: Column, make) -> Column:
    out = F.lit(False)
    for k in KINDS:
        out = F.when(kind == k, make(k)).otherwise(out)
    return out


def _votes(text: Column, s: Column) -> Column:
    before = F.lower(text.substr(F.greatest(F.lit(1), s["start"] - 23).cast("int"), F.least(F.lit(24), s["start"]).cast("int")))
    edge = lambda at: F.regexp_like(F.concat(F.lit(" "), text.substr(at.cast("int"), F.lit(1))), F.lit(r"^ (?:[\s,;:!?\"'()<>|.]|)$"))
    form = valid(s["kind"], F.regexp_replace(s["text"], r"\x20?[(\[](at|dot)[)\]]\x20?", "."))
    told = [form, _by_kind(s["kind"], lambda k: F.regexp_like(s["text"], F.lit(GAZETTEER[k]))), _by_kind(s["kind"], lambda k: F.regexp_like(before, F.lit(CONTEXT[k]))), F.when(s["start"] == 0, True).otherwise(edge(s["start"])) & edge(s["end"] + 1)]
    out = F.lit(0)
    for j, v in enumerate(told):
        out = out + F.when(F.coalesce(v, F.lit(False)), 1 << j).otherwise(0)
    return out


def _bit(v: Column, j: int) -> Column:
    return F.shiftright(v, j).bitwiseAND(F.lit(1)).cast("double")


def _posterior(p: Column, v: Column) -> Column:
    yes, no = p["pi"], 1 - p["pi"]
    for j in range(LABELERS):
        b = _bit(v, j)
        yes = yes * (b * p[f"a{j}"] + (1 - b) * (1 - p[f"a{j}"]))
        no = no * (b * p[f"b{j}"] + (1 - b) * (1 - p[f"b{j}"]))
    return yes / (yes + no)


def _em(pats: Column) -> Column:
    """Reliabilities after STEPS rounds; a prior of one vote each way keeps every rate inside (0, 1)."""
    start = F.struct(F.lit(0.5).alias("pi"), *[F.lit(0.8).alias(f"a{j}") for j in range(LABELERS)], *[F.lit(0.2).alias(f"b{j}") for j in range(LABELERS)])

    def step(p, _):
        with_q = F.transform(pats, lambda x: F.struct(x["v"].alias("v"), (x["n"] * _posterior(p, x["v"])).alias("y"), (x["n"] * (1 - _posterior(p, x["v"]))).alias("z")))
        fold = F.aggregate(
            with_q,
            F.struct(*[F.lit(0.0).alias(c) for c in ["y", "z", *[f"y{j}" for j in range(LABELERS)], *[f"z{j}" for j in range(LABELERS)]]]),
            lambda s, x: F.struct((s["y"] + x["y"]).alias("y"), (s["z"] + x["z"]).alias("z"), *[(s[f"y{j}"] + x["y"] * _bit(x["v"], j)).alias(f"y{j}") for j in range(LABELERS)], *[(s[f"z{j}"] + x["z"] * _bit(x["v"], j)).alias(f"z{j}") for j in range(LABELERS)]),
            lambda s: F.struct(((s["y"] + 1) / (s["y"] + s["z"] + 2)).alias("pi"), *[((s[f"y{j}"] + 1) / (s["y"] + 2)).alias(f"a{j}") for j in range(LABELERS)], *[((s[f"z{j}"] + 1) / (s["z"] + 2)).alias(f"b{j}") for j in range(LABELERS)]),
        )
        return fold

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)


def _features(kind: Column, v: Column) -> Column:
    return F.array(F.lit(1.0), *[_bit(v, j) for j in range(LABELERS)], _bit(v, 0) * _bit(v, 2), *[F.when(kind == k, 1.0).otherwise(0.0) for k in KINDS])


def _logit(w: Column, f: Column) -> Column:
    z = F.aggregate(F.zip_with(w, f, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + F.exp(-z))


def _classifier(pats: Column, total: float) -> Column:
    """Weights of the logistic model, by gradient steps on the posteriors, every pattern weighted by the root of its count."""
    size = 2 + LABELERS + len(KINDS)
    zero = F.array(*[F.lit(0.0)] * size)

    def step(w, _):
        grad = F.aggregate(pats, zero, lambda g, x: F.zip_with(g, x["f"], lambda a, b: a + x["w"] * (x["q"] - _logit(w, x["f"])) * b))
        return F.zip_with(w, grad, lambda a, b: a + 2.0 * (b / total - 0.001 * a))

    return F.aggregate(F.sequence(F.lit(1), F.lit(150)), zero, step)


def _fit(cands: DataFrame) -> dict[tuple[str, int], float]:
    """The classifier's probability for each kind and pattern of votes that occurs: at most 4 x 16 rows come to the driver."""
    counts = cands.select(F.explode("cands").alias("c")).groupBy(F.col("c.kind").alias("kind"), F.col("c.v").alias("v")).agg(F.count("*").cast("double").alias("n"))
    table = [(r.kind, r.v, r.n) for r in counts.orderBy("kind", "v").collect()]
    if not table:
        return {}
    one = cands.sparkSession.range(1)  # each result of a fold is read before the next uses it, or Catalyst would put the fold where it is used
    pats = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(n).alias("n")) for _, v, n in table])
    p = one.select(_em(pats).alias("p")).first().p.asDict()
    p = {k: F.lit(x) for k, x in p.items()}
    q = one.select(F.array(*[_posterior(p, F.lit(v)) for _, v, _ in table]).alias("q")).first().q
    pats = F.array(*[F.struct(F.lit(n**0.5).alias("w"), _features(F.lit(k), F.lit(v)).alias("f"), F.lit(y).alias("q")) for (k, v, n), y in zip(table, q)])
    w = F.array(*[F.lit(x) for x in one.select(_classifier(pats, sum(n**0.5 for _, _, n in table)).alias("w")).first().w])
    scores = one.select(F.array(*[_logit(w, _features(F.lit(k), F.lit(v))) for k, v, _ in table]).alias("s")).first().s
    return {(k, v): score for (k, v, _), score in zip(table, scores)}


def personal_data(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, base, spans[, kept columns]): ``base`` are the matches of the fixed patterns, ``spans`` those and what the classifier adds, both arrays of
    kind, start, end, text (offsets in code points) by kind as listed, then start.

    A null text counts as empty and has no spans; rows that repeat an id are kept apart; an empty table gives an empty one; columns not named in
    ``keep`` are ignored. Added spans never overlap a base span of their kind."""
    stage = C.Stage(spark, "pii")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"), *keep)
    for k, p in BASE.items():
        rows = rows.withColumn(f"_{k}", spans_of(F.col("_t"), p, k))
    for k, p in LOOSE.items():
        rows = rows.withColumn(f"_loose_{k}", spans_of(F.col("_t"), p, k))
    every = F.concat(*[F.col(f"_{k}") for k in KINDS])
    rows = rows.withColumn("_all", every).withColumn("base", F.filter("_all", lambda s: valid(s["kind"], s["text"])))
    loose = F.filter(F.concat(*[F.col(f"_loose_{k}") for k in LOOSE]), lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    voted = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), _votes(F.col("_t"), s).alias("v"))
    rows = rows.withColumn("cands", F.transform(F.concat("_all", loose), voted))
    held = stage.table(rows.select("doc_id", "base", "cands", *keep))
    model = _fit(held.select("cands"))
    good = [F.lit(f"{k}:{v}") for (k, v), score in sorted(model.items()) if score >= threshold]
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))
    if good:
        form = lambda s: s["v"].bitwiseAND(F.lit(1)) == 1
        more = F.filter("cands", lambda s: form(s) & F.array_contains(F.array(*good), F.concat_ws(":", s["kind"], s["v"].cast("string"))) & ~F.exists(F.col("base"), lambda b: (b["kind"] == s["kind"]) & (b["start"] < s["end"]) & (s["start"] < b["end"])))
        added = F.transform(more, plain)
    else:
        added = F.array().cast(_SPAN)
    spans = F.concat("base", added)
    only = lambda k: F.filter(spans, lambda s: s["kind"] == k)
    order = F.concat(*[F.array_sort(only(k), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)) for k in KINDS])
    return held.select("doc_id", "base", order.alias("spans"), *keep)


def redact(found: DataFrame, text: Column) -> Column:
    """The text with each span replaced by its kind in brackets; where spans overlap, the one that starts first, then the longer, counts."""
    spans = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"))))
    sub = lambda a, n: text.substr((a + 1).cast("int"), n.cast("int"))

    def step(acc, s):
        take = s["start"] >= acc["at"]
        return F.struct(F.when(take, -s["neg"]).otherwise(acc["at"]).alias("at"), F.when(take, F.concat(acc["out"], sub(acc["at"], s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(spans, first, step, lambda a: F.concat(a["out"], sub(a["at"], F.greatest(F.lit(0), F.length(text) - a["at"]))))
    return F.when(F.size("spans") > 0, whole).otherwise(text)


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(spark, C.read(spark, sf_dir, "documents", "doc_id", "text"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
