"""Registered queries over the driver's tables, each with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import signal as S
from ..functions import text as X
from ..operators import align, dictionary, lm, metrics, timeline

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


KEY, ORDER = ["user_id"], ["ts", "event_id"]
#: A label's number, as frames have it.
def code():
    return F.when(F.col("event_type") < "c", 0).when(F.col("event_type") < "p", 1).otherwise(2)


CODE_SQL = "CASE WHEN event_type < 'c' THEN 0 WHEN event_type < 'p' THEN 1 ELSE 2 END"


# ---- timelines


@query("SELECT user_id, event_id, ts, event_type FROM (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR p <> event_type")
def switch_timeline(spark, sf_dir):
    return timeline.switches(events(spark, sf_dir), KEY, ORDER, "event_type").select("user_id", "event_id", "ts", "event_type")


@query("SELECT user_id, i AS frame FROM (SELECT *, lag(event_type) OVER w AS p, (row_number() OVER w - 1)::BIGINT AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE i >= 1 AND p <> event_type")
def boundaries(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("frame", (F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) - 1).cast("long"))
    return timeline.switches(e, KEY, ORDER, "event_type", first=False).select("user_id", "frame")


@query("""SELECT event_type, count(*) AS segments, round(sum(d), 3) AS seconds FROM (SELECT event_type,
  (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS d FROM events) WHERE d IS NOT NULL GROUP BY event_type""")
def label_durations(spark, sf_dir):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = F.lead(micros).over(Window.partitionBy("user_id").orderBy(*ORDER)) - micros
    e = events(spark, sf_dir).select("event_type", (gap / 1e6).alias("d")).where("d IS NOT NULL")
    return e.groupBy("event_type").agg(F.count("*").alias("segments"), F.round(F.sum("d"), 3).alias("seconds"))


RUNS_SQL = """r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run_id FROM
  (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS c FROM events))"""


@query(f"WITH {RUNS_SQL} SELECT user_id, run_id, any_value(event_type) AS event_type, count(*) AS run_length FROM r GROUP BY user_id, run_id")
def run_lengths(spark, sf_dir):
    r = timeline.runs(events(spark, sf_dir), KEY, ORDER, "event_type")
    return r.groupBy("user_id", "run_id").agg(F.first("event_type").alias("event_type"), F.count("*").alias("run_length"))


@query(f"""WITH f AS (SELECT *, value < 50 AS quiet FROM events), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_id FROM
  (SELECT *, CASE WHEN lag(quiet) OVER (PARTITION BY user_id ORDER BY ts, event_id) = quiet THEN 0 ELSE 1 END AS c FROM f)),
n AS (SELECT *, count(*) OVER (PARTITION BY user_id, run_id) AS k FROM r)
SELECT event_id, quiet AND k >= 3 AS held, CASE WHEN quiet AND k >= 3 THEN 2 ELSE {CODE_SQL} END AS label FROM n""")
def sustained_runs(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("quiet", F.col("value") < 50).withColumn("label", code())
    return timeline.sustained(e, KEY, ORDER, "quiet", 3, "label", F.lit(2)).select("event_id", "held", F.col("held_label").alias("label"))


@query(f"""SELECT event_id, list_sort([coalesce(lag(l) OVER w, l), l, coalesce(lead(l) OVER w, l)])[2] AS median FROM (SELECT *, {CODE_SQL} AS l FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def median_filter3(spark, sf_dir):
    return timeline.median3(events(spark, sf_dir).withColumn("l", code()), KEY, ORDER, "l").select("event_id", "median")


HOURLY_SQL = "h AS (SELECT date_diff('hour', TIMESTAMP '2000-01-01', ts)::BIGINT AS hour, count(*) AS n, avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END) AS share FROM events GROUP BY 1)"


def hourly(spark, sf_dir):
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 - 946684800) / 3600).cast("long")
    return events(spark, sf_dir).groupBy(hour.alias("hour")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("value") >= 50, 1.0).otherwise(0.0)).alias("share"))


@query(f"""WITH {HOURLY_SQL}, w AS (SELECT hour % 4 AS part, hour, round(avg(share) OVER f, 9) AS mean, count(*) OVER f AS k FROM h WINDOW f AS (PARTITION BY hour % 4 ORDER BY hour ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))
SELECT part, arg_max(hour, (mean, -hour)) AS start, max(mean) AS mean FROM w WHERE k = 6 GROUP BY part""")
def best_sliding_window(spark, sf_dir):
    h = hourly(spark, sf_dir).withColumn("part", F.col("hour") % 4)
    return timeline.best_window(h, ["part"], "hour", "share", 6, digits=9)


@query("SELECT time_bucket(INTERVAL 28 SECOND, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def tumbling_windows(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "28 seconds").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


@query("""SELECT make_timestamp((b - 3600 * k) * 1000000) AS start, count(*) AS n FROM (SELECT (epoch_us(ts) // 3600000000) * 3600 AS b FROM events) CROSS JOIN range(3) AS t(k) GROUP BY 1""")
def hopping_windows(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT (user_id % 7)::BIGINT AS clip, count(*) AS frames, coalesce(sum(g), 0)::BIGINT AS windows FROM (SELECT *, CASE WHEN i % 3 = 0 AND i + 9 <= n THEN 1 ELSE 0 END AS g FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id % 7) AS n FROM events)) GROUP BY 1")
def hop_starts(spark, sf_dir):
    n = events(spark, sf_dir).groupBy((F.col("user_id") % 7).alias("clip")).agg(F.count("*").alias("frames"))
    return n.select("clip", "frames", F.size(timeline.hops(F.col("frames"), 9, 3)).cast("long").alias("windows"))


SEGMENTS_SQL = f"""s AS (SELECT user_id, (row_number() OVER w)::BIGINT AS seg, (epoch_us(ts) // 1000000 % 86400) / 100.0::DOUBLE AS start_s, {CODE_SQL} AS label FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT *, start_s + 0.05::DOUBLE AS end_s FROM s)"""


def user_segments(spark, sf_dir):
    e = events(spark, sf_dir)
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long") % 86400
    e = e.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)).cast("long").alias("seg"), (second / 100.0).alias("start_s"), code().alias("label"))
    return e.withColumn("end_s", F.col("start_s") + 0.05)


@query(f"""WITH {SEGMENTS_SQL}, f AS (SELECT user_id, seg, label, unnest(range((floor(floor(start_s * 16000) / 160))::BIGINT, (floor(floor(end_s * 16000) / 160))::BIGINT)) AS frame_idx FROM t)
SELECT user_id, frame_idx, arg_max(label, seg) AS label FROM f GROUP BY ALL""")
def segments_to_frames(spark, sf_dir):
    return timeline.segments_to_frames(user_segments(spark, sf_dir), KEY)


@query(f"""WITH {SEGMENTS_SQL}, w AS (SELECT user_id, seg // 3 AS win, max(label) AS label FROM t GROUP BY ALL HAVING max(label) > 0), f AS (SELECT user_id, seg AS frame_idx FROM t)
SELECT f.user_id, f.frame_idx, coalesce(w.label, 0) AS label FROM f LEFT JOIN w ON w.user_id = f.user_id AND w.win = f.frame_idx // 3""")
def windows_to_frames(spark, sf_dir):
    s = user_segments(spark, sf_dir)
    wins = s.groupBy("user_id", F.floor(F.col("seg") / 3).cast("long").alias("win")).agg(F.max("label").alias("label")).where("label > 0")
    return timeline.spread_windows(s.select("user_id", F.col("seg").alias("frame_idx")), wins, KEY, 3, 0)


@query(f"""WITH {RUNS_SQL}, s AS (SELECT user_id, event_type AS label, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 3.0::DOUBLE AS start_s, run_id FROM r)
SELECT user_id, min(start_s) AS start_s, max(start_s) + 3.0::DOUBLE AS end_s, any_value(label) AS label FROM s GROUP BY user_id, run_id""")
def merged_segments(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", F.col("event_type").alias("label"), (F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) * 3.0).alias("start_s"))
    return timeline.merge_segments(e.withColumn("end_s", F.col("start_s") + 3.0), KEY).select("user_id", "start_s", "end_s", "label")


@query(f"SELECT user_id, arg_max(l, (n, -l)) AS label, max(n) AS votes FROM (SELECT user_id, {CODE_SQL} AS l, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def majority_vote(spark, sf_dir):
    return timeline.majority(events(spark, sf_dir).withColumn("l", code()), KEY, "l")


@query("""SELECT event_id, round(coalesce(sum(value + 0.3) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS start_s FROM events""")
def running_offsets(spark, sf_dir):
    out = timeline.alternate(events(spark, sf_dir), "value", ORDER, KEY)
    return out.select("event_id", F.round("start_s", 6).alias("start_s"))


@query(f"""WITH {SEGMENTS_SQL} SELECT user_id, seg, round(greatest(0, start_s - 100.0), 6) AS start_s, round(end_s - 100.0, 6) AS end_s FROM t WHERE end_s - 100.0 > 0 AND start_s - 100.0 < 300.0""")
def cropped_segments(spark, sf_dir):
    out = timeline.crop(user_segments(spark, sf_dir), F.lit(100.0), F.lit(300.0))
    return out.select("user_id", "seg", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query("SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS hms, (s * 16000 // 160)::BIGINT AS frame FROM (SELECT event_id, epoch_us(ts) // 1000000 % 86400 AS s FROM events)")
def clock_times(spark, sf_dir):
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long") % 86400
    return events(spark, sf_dir).select("event_id", X.hms(second).alias("hms"), X.to_frame(second).alias("frame"))


# ---- evaluation


def judged(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rule = F.when(F.col("n_chars") < 400, 0).when(F.col("n_chars") < 3000, 1).otherwise(2)
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", "n_chars", (F.col("quality") + F.col("toxic")).alias("truth"), rule.alias("pred"), "toxic")


JUDGED_SQL = "j AS (SELECT l.doc_id, d.n_chars, l.quality + l.toxic AS truth, CASE WHEN n_chars < 400 THEN 0 WHEN n_chars < 3000 THEN 1 ELSE 2 END AS pred, toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


@query(f"WITH {JUDGED_SQL}, g AS (SELECT x.v::INT AS truth, y.v::INT AS pred FROM range(3) x(v), range(3) y(v)) SELECT g.truth, g.pred, count(j.doc_id) AS n FROM g LEFT JOIN j ON j.truth = g.truth AND j.pred = g.pred GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(judged(spark, sf_dir), "truth", "pred", [0, 1, 2])


@query(f"WITH {JUDGED_SQL}, l AS (SELECT range AS l FROM range(3)) SELECT avg(coalesce(2.0 * tp / nullif(a + p, 0), 0)) AS macro_f1 FROM (SELECT l, (SELECT count(*) FROM j WHERE truth = l AND pred = l) AS tp, (SELECT count(*) FROM j WHERE truth = l) AS a, (SELECT count(*) FROM j WHERE pred = l) AS p FROM l)")
def macro_f1(spark, sf_dir):
    return metrics.macro_f1(metrics.confusion(judged(spark, sf_dir), "truth", "pred", [0, 1, 2]))


def boundary_lists(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("frame", (F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) - 1).cast("long"))
    e = e.withColumn("a", F.lag("event_type").over(Window.partitionBy("user_id").orderBy(*ORDER)) != F.col("event_type"))
    e = e.withColumn("b", (F.lag("value").over(Window.partitionBy("user_id").orderBy(*ORDER)) < 50) != (F.col("value") < 50))
    some = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.col("frame"))))
    return e.groupBy("user_id").agg(some("a").alias("pred"), some("b").alias("truth"))


BOUNDARY_SQL = """e AS (SELECT *, (row_number() OVER w - 1)::BIGINT AS frame, lag(event_type) OVER w <> event_type AS a, (lag(value) OVER w < 50) <> (value < 50) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
l AS (SELECT user_id, coalesce(list(frame ORDER BY frame) FILTER (WHERE a), []) AS pred, coalesce(list(frame ORDER BY frame) FILTER (WHERE b), []) AS truth FROM e GROUP BY user_id),
g AS (SELECT user_id, 0 AS i, []::BIGINT[] AS used FROM l UNION ALL
  SELECT user_id, i + 1, CASE WHEN near IS NULL THEN used ELSE list_append(used, near % 1000000000) END FROM (
    SELECT g.user_id, g.i, g.used, list_min(list_transform(list_filter(l.truth, lambda t: abs(t - l.pred[g.i + 1]) <= 2 AND NOT list_contains(g.used, t)), lambda t: abs(t - l.pred[g.i + 1]) * 1000000000 + t)) AS near
    FROM g JOIN l ON l.user_id = g.user_id WHERE g.i < len(l.pred))),
m AS (SELECT l.user_id, len(l.pred) AS n, len(l.truth) AS k, len(g.used)::BIGINT AS matched FROM l JOIN g ON g.user_id = l.user_id AND g.i = len(l.pred)),
q AS (SELECT user_id, matched, CASE WHEN n = 0 AND k = 0 THEN 1.0 WHEN n = 0 OR k = 0 THEN 0.0 ELSE matched / n::DOUBLE END AS "precision", CASE WHEN n = 0 AND k = 0 THEN 1.0 WHEN n = 0 OR k = 0 THEN 0.0 ELSE matched / k::DOUBLE END AS recall FROM m),
s AS (SELECT *, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) AS f1 FROM q)"""


@query(f"WITH RECURSIVE {BOUNDARY_SQL} SELECT round(avg(f1), 9) AS mean_f1, count(*) AS clips FROM s")
def mean_boundary_f1(spark, sf_dir):
    return metrics.mean_boundary_f1(boundary_lists(spark, sf_dir), KEY, tolerance=2).select(F.round("mean_f1", 9).alias("mean_f1"), "clips")


@query(f'WITH RECURSIVE {BOUNDARY_SQL} SELECT user_id, matched, round("precision", 9) AS "precision", round(recall, 9) AS recall, round(f1, 9) AS f1 FROM s')
def boundary_f1(spark, sf_dir):
    out = metrics.boundary_f1(boundary_lists(spark, sf_dir), KEY, tolerance=2)
    return out.select("user_id", "matched", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


SWEEP_SQL = f"""{JUDGED_SQL}, s AS (SELECT doc_id AS id, n_chars::DOUBLE AS score, toxic AS y, (row_number() OVER w)::BIGINT AS rank, sum(1 - toxic) OVER w / greatest(1, sum(1 - toxic) OVER ())::DOUBLE AS fpr,
  1 - sum(toxic) OVER w / greatest(1, sum(toxic) OVER ())::DOUBLE AS fnr FROM j WINDOW w AS (ORDER BY n_chars DESC, doc_id))"""


@query(f"WITH {SWEEP_SQL} SELECT id, score, y, rank, round(fpr, 9) AS fpr, round(fnr, 9) AS fnr FROM s")
def eer_sweep(spark, sf_dir):
    s = metrics.eer_sweep(judged(spark, sf_dir), "n_chars", "toxic", "doc_id")
    return s.select("id", "score", "y", "rank", F.round("fpr", 9).alias("fpr"), F.round("fnr", 9).alias("fnr"))


@query(f"""WITH {SWEEP_SQL}, c AS (SELECT *, CASE WHEN fpr - fnr < 0 THEN 1 ELSE 0 END AS neg, lead(CASE WHEN fpr - fnr < 0 THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS nxt FROM s),
p AS (SELECT * FROM c WHERE neg <> nxt ORDER BY rank LIMIT 1), q AS (SELECT * FROM c ORDER BY abs(fpr - fnr), rank LIMIT 1), u AS (SELECT * FROM p UNION ALL SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM p))
SELECT round((fpr + fnr) / 2, 9) AS eer, score AS threshold FROM u""")
def equal_error_rate(spark, sf_dir):
    s = metrics.eer_sweep(judged(spark, sf_dir), "n_chars", "toxic", "doc_id")
    return metrics.eer(s).select(F.round("eer", 9).alias("eer"), "threshold")


def whole_turn_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("hyp")).where("hyp IS NOT NULL")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.withColumn("ref", F.lag("hyp").over(w)).where("ref IS NOT NULL AND ref <> ''")


# DuckDB's distance is of bytes: characters beyond ASCII are first put in the place of control characters that no text has
PAIRS_SQL = """b AS (SELECT string_agg(c, '' ORDER BY c) AS far, string_agg(chr(n::INT), '' ORDER BY c) AS near FROM (SELECT c, row_number() OVER (ORDER BY c) + CASE WHEN row_number() OVER (ORDER BY c) > 8 THEN 5 ELSE 0 END AS n
  FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM conversations) WHERE unicode(c) > 127)),
p AS (SELECT *, lag(hyp) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM (SELECT conv_id, turn, text AS hyp FROM conversations WHERE text IS NOT NULL))"""


@query(f"""WITH {PAIRS_SQL} SELECT conv_id, turn, round(levenshtein(translate(ref, far, near), translate(hyp, far, near)) / length(ref)::DOUBLE, 9) AS cer FROM p, b WHERE ref IS NOT NULL AND ref <> ''""")
def character_error_rate(spark, sf_dir):
    return whole_turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(metrics.cer(F.col("ref"), F.col("hyp")), 9).alias("cer"))


# words that one side alone has match nothing and share a byte; those of both have one each, of 120
@query(r"""WITH p AS (SELECT *, lag(h) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[\s\x{0085}\x{2028}\x{2029}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '') AS h FROM conversations WHERE text IS NOT NULL)),
s AS (SELECT *, list_intersect(r, h) AS common FROM p WHERE r IS NOT NULL AND len(r) > 0)
SELECT conv_id, turn, round(levenshtein(array_to_string(list_transform(r, lambda x: chr(coalesce(nullif(list_position(common, x), 0) + 2, 1)::INT)), ''), array_to_string(list_transform(h, lambda x: chr(coalesce(nullif(list_position(common, x), 0) + 2, 2)::INT)), '')) / len(r)::DOUBLE, 9) AS wer FROM s""")
def word_error_rate(spark, sf_dir):
    p = whole_turn_pairs(spark, sf_dir).withColumn("r", X.split_words(F.col("ref"))).withColumn("h", X.split_words(F.col("hyp"))).where(F.size("r") > 0)
    return p.select("conv_id", "turn", F.round(metrics.wer(F.col("r"), F.col("h")), 9).alias("wer"))


# ---- text

LM_TOKENS_SQL = "list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Zऀ-ॿ]+(?:''[a-z]+)?|[0-9]+'), lambda x: lower(x))"


@query(f"SELECT conv_id, turn, array_to_string({LM_TOKENS_SQL}, ' ') AS tokens FROM conversations")
def lm_tokenize(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.array_join(X.lm_tokens(F.coalesce("text", F.lit(""))), " ").alias("tokens"))


@query("SELECT doc_id, len(t)::BIGINT AS n, coalesce(len(list_filter(t, lambda x: regexp_matches(x, '^[a-z]'))), 0)::BIGINT AS latin FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z'']+|[ऀ-ॿ]+|[.,!?;:\\-]') AS t FROM documents)")
def script_tokens(spark, sf_dir):
    n, latin = X.count_script_tokens(F.lower(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n"), latin.cast("long").alias("latin"))


def _sql_map(d):
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in d.items()) + "}"


def _ipa_sql(word: str) -> str:
    from ..functions import tables as T

    rules = "|".join(T.LETTER_RULES)
    return f"coalesce(d.en[{word}], array_to_string(list_transform(regexp_extract_all({word}, '{rules}'), lambda x: d.rules[x]), ''))"


def _dicts_sql() -> str:
    from ..functions import tables as T

    return f"d AS (SELECT {_sql_map(T.ENGLISH_WORDS)} AS en, {_sql_map(T.LETTER_RULES)} AS rules)"


@query(f"WITH {_dicts_sql()}, w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS word FROM benchmark) SELECT word, {_ipa_sql('word')} AS ipa FROM w, d")
def en_to_ipa(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select(F.explode(X.pieces(F.lower(F.coalesce("text", F.lit(""))), "[a-z]+")).alias("word")).distinct()
    return w.select("word", X.english_to_ipa(F.col("word")).alias("ipa"))


@query(f"""WITH {_dicts_sql()}, t AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z'']+|[ऀ-ॿ]+|[.,!?;:\\-]') AS t FROM benchmark)
SELECT item_id, array_to_string(list_transform(t, lambda x: CASE WHEN regexp_matches(x, '^[a-z]') THEN {_ipa_sql('x')} ELSE x END), '·') AS ipa FROM t, d""")
def text_to_ipa(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.text_to_ipa(F.coalesce("text", F.lit(""))).alias("ipa"))


@query("SELECT * FROM (VALUES (0, 'kməl'), (1, 'nməst̪eː'), (4, '')) v(id, ipa)")
def dev_to_ipa(spark, sf_dir):
    rows = spark.createDataFrame([(0, "कमल"), (1, "नमस्ते"), (4, "")], "id int, word string")
    return rows.select("id", X.devanagari_to_ipa(F.col("word")).alias("ipa"))


@query("SELECT * FROM (VALUES (0, 'बट , इलअल नैवैर बै लैकिङ .'), (1, 'बटअ'), (2, '')) v(id, deva)")
def ipa_to_deva(spark, sf_dir):
    rows = spark.createDataFrame([(0, "bʌt·,·ɪll·nɛvɛr·bɛ·lækɪŋ·."), (1, "bʌt"), (2, "")], "id int, ipa string")
    return rows.select("id", X.ipa_to_devanagari(F.col("ipa")).alias("deva"))


def small_dictionary(spark):
    return spark.createDataFrame([("the", "DET"), ("of", "PREP"), ("de", "PREP"), ("und", "CONJ"), ("la", "DET")], "key string, ol string")


@query("""WITH m AS (SELECT MAP {'the': 'DET', 'of': 'PREP', 'de': 'PREP', 'und': 'CONJ', 'la': 'DET'} AS m)
SELECT conv_id, turn, array_to_string(list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x{0085}\\x{2028}\\x{2029}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: x <> ''),
  lambda x: coalesce(m[lower(regexp_replace(x, '^[.,!?;:]+|[.,!?;:]+$', '', 'g'))], x)), ' ') AS translation FROM conversations, m""")
def dict_translate(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return dictionary.translate(c, small_dictionary(spark), ["conv_id", "turn"])


@query("""WITH b AS (SELECT DISTINCT p_brand FROM part), t AS (SELECT DISTINCT p_type FROM part), s AS (SELECT p_brand AS key, (row_number() OVER (ORDER BY p_brand) - 1)::INT AS ord FROM b UNION ALL
  SELECT p_type, ((SELECT count(*) FROM b) + row_number() OVER (ORDER BY p_type) - 1)::INT FROM t),
c AS (SELECT m.key || '_' || h.key AS key, m.ord AS mo, h.ord AS ho FROM s m JOIN b ON m.key = b.p_brand CROSS JOIN (SELECT s.* FROM s JOIN t ON s.key = t.p_type) h),
n AS (SELECT key FROM c WHERE key NOT IN (SELECT key FROM s) ORDER BY mo, ho LIMIT greatest(0, 100 - (SELECT count(*) FROM s)))
SELECT key, replace(key, '_', '-') AS ol FROM (SELECT key FROM s UNION ALL SELECT key FROM n)""")
def corpus_expand(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    side = lambda c, k: part.select(F.lit(k).alias("side"), F.col(c).alias("key")).distinct()  # noqa: E731  dozens of brands and of types
    every = side("p_brand", 0).unionByName(side("p_type", 1)).withColumn("ord", F.row_number().over(Window.orderBy("side", "key")) - 1)
    entries = every.select("ord", "key", F.replace("key", F.lit("_"), F.lit("-")).alias("ol"), F.col("key").alias("deva"), F.col("key").alias("hi"), F.col("key").alias("gloss"))
    out = dictionary.compounds(entries, every.where("side = 0"), every.where("side = 1"), 100)
    return out.select("key", F.replace("key", F.lit("_"), F.lit("-")).alias("ol"))


@query("SELECT 500::BIGINT AS entries, 'embedding_state' AS last")
def dictionary_500(spark, sf_dir):
    return dictionary.full_dictionary(spark).agg(F.count("*").alias("entries"), F.max_by("key", "ord").alias("last"))


@query(r"""WITH RECURSIVE f AS (SELECT doc_id, trim(replace(coalesce(text, ''), '·', ' ')) AS flat FROM documents),
l AS (SELECT doc_id, flat, list_filter(list_transform(string_split(replace(flat, chr(10), ' '), '. '), lambda x: trim(x)), lambda x: x <> '') AS parts FROM f),
g AS (SELECT doc_id, 0 AS i, '' AS buf, NULL::VARCHAR AS done, false AS last FROM l
  UNION ALL SELECT g.doc_id, g.i + 1, CASE WHEN length(g.buf) + length(l.parts[g.i + 1]) + 2 <= 400 THEN g.buf || l.parts[g.i + 1] || '. ' ELSE l.parts[g.i + 1] || '. ' END,
    CASE WHEN length(g.buf) + length(l.parts[g.i + 1]) + 2 > 400 AND g.buf <> '' THEN trim(g.buf) END, g.i + 1 = len(l.parts) FROM g JOIN l ON l.doc_id = g.doc_id WHERE g.i < len(l.parts)),
c AS (SELECT doc_id, i, done AS chunk FROM g WHERE done IS NOT NULL UNION ALL SELECT doc_id, i + 1, trim(buf) FROM g WHERE last UNION ALL SELECT doc_id, 0, flat[1:400] FROM l WHERE len(parts) = 0)
SELECT doc_id, count(*)::INT AS chunks, max(length(chunk))::INT AS longest, sha256(string_agg(chunk, '|' ORDER BY i)) AS digest FROM c GROUP BY doc_id""")
def pack_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.pack_chunks(F.coalesce("text", F.lit(""))).alias("c"))
    return d.select("doc_id", F.size("c").alias("chunks"), F.array_max(F.transform("c", F.length)).alias("longest"), F.sha2(F.array_join("c", "|"), 256).alias("digest"))


RUN_SQL = "|".join((f"\\{c}" if not c.isdigit() else c) + "{10,}" for c in "0123456789!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~") + "|''{10,}"


@query(f"SELECT doc_id, length(t) AS n, sha256(t) AS digest FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '{RUN_SQL}', '.', 'g') AS t FROM documents)")
def clean_runs(spark, sf_dir):
    t = X.clean_runs(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.sha2("t", 256).alias("digest"))


# ---- language model

GRAMS_SQL = f"""tk AS (SELECT list_concat(list_concat(['<s>', '<s>'], {LM_TOKENS_SQL}), ['</s>']) AS t FROM benchmark),
gr AS (SELECT o AS "order", array_to_string(t[i:i + o - 1], ' ') AS gram, count(*) AS c FROM (SELECT t, o, unnest(range(1, len(t) - o + 2)) AS i FROM tk, (SELECT unnest([1, 2, 3]) AS o)) GROUP BY ALL)"""
MODEL_SQL = f"""{GRAMS_SQL}, me AS (SELECT "order", coalesce(sum(CASE WHEN c = 1 THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN c = 1 THEN 1 ELSE 0 END) + 2 * sum(CASE WHEN c = 2 THEN 1 ELSE 0 END), 0), 0.5) AS d, count(*) AS types, sum(c)::BIGINT AS tokens FROM gr GROUP BY 1),
cx AS (SELECT regexp_replace(gram, ' ?[^ ]+$', '') AS h, count(*) AS types FROM gr WHERE "order" > 1 GROUP BY 1), ch AS (SELECT cx.h, cx.types, gr.c FROM cx JOIN gr ON gr.gram = cx.h),
ct AS (SELECT regexp_extract(gram, '([^ ]+)$', 1) AS w, count(*) AS n FROM gr WHERE "order" = 2 GROUP BY 1),
dn AS (SELECT (sum(CASE WHEN "order" = 2 THEN c ELSE 0 END) + sum(CASE WHEN "order" = 1 THEN 1 ELSE 0 END) + 1)::DOUBLE AS v FROM gr),
d2 AS (SELECT d FROM me WHERE "order" = 2), d3 AS (SELECT d FROM me WHERE "order" = 3)"""


def _prob_sql(src: str, out: str) -> str:
    return f"""{out}b AS (SELECT q.*, (coalesce(ct.n, 0) + 1) / (SELECT v FROM dn) AS lo, o.c AS c1, o.types AS t1, t.c AS c2, t.types AS t2, g2.c AS k2, g3.c AS k3 FROM {src} q LEFT JOIN ct ON ct.w = q.w LEFT JOIN ch o ON o.h = q.h1 LEFT JOIN ch t ON t.h = q.h2 || ' ' || q.h1
  LEFT JOIN gr g2 ON g2.gram = q.h1 || ' ' || q.w LEFT JOIN gr g3 ON g3.gram = q.h2 || ' ' || q.h1 || ' ' || q.w),
{out}i AS (SELECT *, CASE WHEN c1 IS NULL THEN lo ELSE greatest(coalesce(k2, 0) - (SELECT d FROM d2), 0) / c1 + (SELECT d FROM d2) * t1 / c1 * lo END AS bi FROM {out}b),
{out} AS (SELECT *, CASE WHEN c2 IS NULL THEN bi ELSE greatest(coalesce(k3, 0) - (SELECT d FROM d3), 0) / c2 + (SELECT d FROM d3) * t2 / c2 * bi END AS p FROM {out}i)"""


@query(f'WITH {GRAMS_SQL} SELECT "order"::INT AS "order", gram, c FROM gr')
def ngram_counts(spark, sf_dir):
    return lm.ngrams(table(spark, sf_dir, "benchmark")).select(F.col("order").cast("int").alias("order"), "gram", "c")


@query(f'WITH {MODEL_SQL} SELECT "order"::INT AS "order", types, tokens, round(d, 9) AS d FROM me')
def kn_discounts(spark, sf_dir):
    return lm.discounts(lm.ngrams(table(spark, sf_dir, "benchmark"))).select(F.col("order").cast("int").alias("order"), "types", "tokens", F.round("d", 9).alias("d"))


STEPS_SQL = f"""cv AS (SELECT conv_id, turn, list_concat(list_concat(['<s>', '<s>'], {LM_TOKENS_SQL}), ['</s>']) AS t FROM conversations),
st AS (SELECT conv_id, turn, t[i] AS w, t[i - 2] AS h2, t[i - 1] AS h1 FROM (SELECT *, unnest(range(3, len(t) + 1)) AS i FROM cv))"""


@query(f"WITH {MODEL_SQL}, {STEPS_SQL}, ds AS (SELECT DISTINCT w, h2, h1 FROM st), {_prob_sql('ds', 'pr')} SELECT w, h2, h1, round(p, 9) AS p FROM pr")
def kn_prob(spark, sf_dir):
    model = lm.fit(table(spark, sf_dir, "benchmark"))
    t = table(spark, sf_dir, "conversations").select(lm.padded(X.lm_tokens(F.coalesce("text", F.lit("")))).alias("t"))
    steps = t.select(F.explode(F.transform(F.sequence(F.lit(2), F.size("t") - 1), lambda i: F.struct(F.get(F.col("t"), i).alias("w"), F.get(F.col("t"), i - 2).alias("h2"), F.get(F.col("t"), i - 1).alias("h1")))).alias("x")).select("x.*").distinct()
    return lm.probabilities(model, steps).select("w", "h2", "h1", F.round("p", 9).alias("p"))


@query(f"WITH {MODEL_SQL}, {STEPS_SQL}, ds AS (SELECT DISTINCT w, h2, h1 FROM st), {_prob_sql('ds', 'pr')} SELECT conv_id, turn, count(*) AS n, round(sum(ln(greatest(p, 1e-12))), 6) AS score FROM st JOIN pr USING (w, h2, h1) GROUP BY ALL")
def kn_score_sequence(spark, sf_dir):
    model = lm.fit(table(spark, sf_dir, "benchmark"))
    out = lm.score_sequences(model, table(spark, sf_dir, "conversations"), ["conv_id", "turn"])
    return out.select("conv_id", "turn", "n", F.round("score", 6).alias("score"))


CANDIDATES_SQL = """vw AS (SELECT w, count(*) AS f FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS w FROM benchmark) GROUP BY 1),
vi AS (SELECT w, (row_number() OVER (ORDER BY w))::INT AS id, f FROM vw), hy AS (SELECT unnest([0, 1, 2])::INT AS hyp),
ca AS (SELECT hyp, id, 'Ġ' || w AS token, w, ((id * 37 + hyp * 11) % 101)::DOUBLE / 10 AS score, 'the' AS h2, CASE hyp WHEN 0 THEN 'of' WHEN 1 THEN 'de' ELSE 'la' END AS h1, (row_number() OVER (PARTITION BY hyp ORDER BY ((id * 37 + hyp * 11) % 101) DESC, id)) AS rk FROM vi, hy)"""


@query(f"WITH {MODEL_SQL}, {CANDIDATES_SQL}, cs AS (SELECT DISTINCT w, h2, h1 FROM ca), {_prob_sql('cs', 'pr')} SELECT hyp, id, token, score, round(score + CASE WHEN rk <= 64 THEN 0.4 * ln(greatest(p, 1e-12)) ELSE 0 END + CASE WHEN id IN (3, 5) THEN 2.0 ELSE 0 END, 6) AS biased FROM ca JOIN pr USING (w, h2, h1)")
def logit_bias_topk(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    words = b.select(F.explode(X.pieces(F.lower(F.coalesce("text", F.lit(""))), "[a-z]+")).alias("w")).distinct()
    ids = lm.numbered(words)  # the vocabulary of a decoder
    c = ids.withColumn("hyp", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    c = c.select("hyp", "id", F.concat(F.lit("Ġ"), "w").alias("token"), (((F.col("id") * 37 + F.col("hyp") * 11) % 101) / F.lit(10.0)).alias("score"), F.lit("the").alias("h2"), F.when(F.col("hyp") == 0, "of").when(F.col("hyp") == 1, "de").otherwise("la").alias("h1"))
    return lm.logit_bias(lm.fit(b), c, boosts=[3, 5]).select("hyp", "id", "token", "score", F.round("biased", 6).alias("biased"))


# ---- signals: an embedding as 64 samples

E_SQL = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", S.doubles(F.col("embedding")).alias("v"))


def long_form(df: DataFrame, c: str = "y") -> DataFrame:
    return df.select("vec_id", F.posexplode(c).alias("i", "y")).select("vec_id", "i", F.round("y", 6).alias("y"))


def _long_sql(expr: str, with_: str = E_SQL) -> str:
    return f"WITH {with_}, o AS (SELECT vec_id, {expr} AS y FROM e) SELECT vec_id, (unnest(range(len(y))))::INT AS i, round(unnest(y), 6) AS y FROM o"


@query(_long_sql("list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda z: z * z))), 1e-12))"))
def l2_normalize(spark, sf_dir):
    return long_form(emb(spark, sf_dir).withColumn("y", S.l2_normalize(F.col("v"))))


@query(_long_sql("list_transform(v, lambda x, i: x - 0.97 * CASE WHEN i > 1 THEN v[i - 1] ELSE 0 END)"))
def pre_emphasis(spark, sf_dir):
    return long_form(emb(spark, sf_dir).withColumn("y", S.pre_emphasis(F.col("v"))))


@query(_long_sql("list_transform(v, lambda x, i: (v[least(len(v), i + 1)] - v[greatest(1, i - 1)] + 2 * (v[least(len(v), i + 2)] - v[greatest(1, i - 2)])) / 10)"))
def delta_features(spark, sf_dir):
    return long_form(emb(spark, sf_dir).withColumn("y", S.delta(F.col("v"))))


@query(_long_sql("list_transform(range(0, 7), lambda k: sqrt(list_avg(list_transform(v[k * 8 + 1:k * 8 + 16], lambda z: z * z))))"))
def frame_energy(spark, sf_dir):
    return long_form(emb(spark, sf_dir).withColumn("y", S.frame_energy(F.col("v"), 16, 8)))


@query(f"""WITH {E_SQL}, p AS (SELECT vec_id, unnest(range(len(v))) AS i, unnest(v) AS x FROM e), g AS (SELECT *, CASE WHEN x > 0 THEN x END AS z, CASE WHEN x > 0 THEN i END AS j FROM p),
n AS (SELECT *, last_value(z IGNORE NULLS) OVER b AS zb, last_value(j IGNORE NULLS) OVER b AS jb, first_value(z IGNORE NULLS) OVER a AS za, first_value(j IGNORE NULLS) OVER a AS ja FROM g
  WINDOW b AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT vec_id, i::INT AS i, round(CASE WHEN x > 0 THEN x WHEN zb IS NULL AND za IS NULL THEN greatest(x, 0) + 0.001 WHEN zb IS NULL THEN za WHEN za IS NULL THEN zb ELSE zb + (za - zb) * (i - jb) / (ja - jb) END, 6) AS y FROM n""")
def interp_gaps(spark, sf_dir):
    f0 = F.transform("v", lambda x: F.greatest(x, F.lit(0.0)))
    return long_form(emb(spark, sf_dir).withColumn("y", S.interp_unvoiced(f0)))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r, label FROM embeddings)
SELECT a.vec_id, round(10 * log10((list_sum(list_transform(a.v, lambda x: x * x)) + 1e-12) / (list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (b.v[i] - a.v[i]) * (b.v[i] - a.v[i]))) + 1e-12)), 6) AS snr_db FROM e a JOIN e b ON a.label = b.label AND b.r = a.r + 1""")
def snr_pairs(spark, sf_dir):
    e = emb(spark, sf_dir)
    w = Window.partitionBy("label").orderBy("vec_id")
    return e.withColumn("n", F.lead("v").over(w)).where("n IS NOT NULL").select("vec_id", F.round(S.snr_db(F.col("v"), F.col("n")), 6).alias("snr_db"))


@query(f"""WITH {E_SQL}, s AS (SELECT *, sqrt(list_avg(list_transform(v, lambda x: x * x))) AS r, list_max(list_transform(v, lambda x: abs(x))) AS p FROM e)
SELECT vec_id, round(20 * log10(r + 1e-9), 6) AS dbfs, round(list_sum(list_transform(v, lambda x: x * power(10, -23 / 20.0) / greatest(r, 1e-6))), 6) AS loud, round(list_sum(list_transform(v, lambda x: x / p * 0.9)), 6) AS peak FROM s""")
def signal_levels(spark, sf_dir):
    v = F.col("v")
    return emb(spark, sf_dir).select("vec_id", F.round(S.dbfs(v), 6).alias("dbfs"), F.round(S.total(S.normalize_loudness(v)), 6).alias("loud"), F.round(S.total(S.normalize_peak(v)), 6).alias("peak"))


@query(f"""WITH {E_SQL} SELECT vec_id, round(list_sum(list_concat(v, list_transform(range(20), lambda x: 0.0::DOUBLE))[1:80]), 6) AS padded, round(list_sum(v[1:10]), 6) AS cut FROM e""")
def fit_length(spark, sf_dir):
    v = F.col("v")
    return emb(spark, sf_dir).select("vec_id", F.round(S.total(S.fit_length(v, 80)), 6).alias("padded"), F.round(S.total(S.fit_length(v, 10)), 6).alias("cut"))


@query(_long_sql("list_transform(range(0, 10), lambda k: v[(k * (len(v) - 1) // 9)::INT + 1])"))
def downsample(spark, sf_dir):
    ix = S.pick_indices(F.size("v"), 10)
    return long_form(emb(spark, sf_dir).withColumn("y", F.transform(ix, lambda i: F.get(F.col("v"), i))))


@query(_long_sql("list_transform(range(0, 64), lambda i: CASE WHEN i >= 63 THEN v[64] ELSE v[(i // 9) * 9 + 1] + (v[(i // 9) * 9 + 10] - v[(i // 9) * 9 + 1]) * (i % 9) / 9 END)"))
def upsample(spark, sf_dir):
    ix = F.array(*[F.lit(9 * k) for k in range(8)])
    ys = F.transform(ix, lambda i: F.get(F.col("v"), i))
    return long_form(emb(spark, sf_dir).withColumn("y", S.interpolate(ix, ys, F.lit(64))))


@query(_long_sql("list_transform(range(0, 64), lambda i: v[i + 1] * list_product([1.0::DOUBLE] || list_transform(list_filter(range(0, 7), lambda k: k * 8 <= i AND i < k * 8 + 16), lambda k: 0.5 + k / 8.0)))"))
def energy_envelope(spark, sf_dir):
    gain = F.array(*[F.lit(0.5 + k / 8.0) for k in range(7)])
    return long_form(emb(spark, sf_dir).withColumn("y", S.apply_gain(F.col("v"), gain, 16, 8)))


@query(_long_sql("list_transform(range(0, 33), lambda k: power(list_sum(list_transform(range(0, 64), lambda i: v[i + 1] * cos(2 * pi() * k * i / 64))), 2) + power(list_sum(list_transform(range(0, 64), lambda i: v[i + 1] * sin(2 * pi() * k * i / 64))), 2))"))
def dft_small(spark, sf_dir):
    return long_form(emb(spark, sf_dir).withColumn("y", S.dft_power(F.col("v"), 64)))


@query(_long_sql("list_transform(range(1, 33), lambda i: greatest(abs(v[i]) - 1.8 * abs(v[i + 32]), 0.05 * abs(v[i])))"))
def spectral_floor(spark, sf_dir):
    mag, noise = F.transform(F.slice("v", 1, 32), F.abs), F.transform(F.slice("v", 33, 32), F.abs)
    return long_form(emb(spark, sf_dir).withColumn("y", S.spectral_floor(mag, noise)))


@query(f"WITH {E_SQL}, p AS (SELECT label, unnest(range(len(v)))::INT AS dim, unnest(v) AS x FROM e) SELECT label, dim, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM p GROUP BY ALL")
def stats_pool(spark, sf_dir):
    out = metrics.stats_pool(emb(spark, sf_dir), ["label"], "v")
    return out.select("label", "dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {E_SQL}, s AS (SELECT *, exp(v[1] - max(v[1]) OVER (PARTITION BY label)) AS w FROM e), p AS (SELECT label, w, unnest(range(len(v)))::INT AS dim, unnest(v) AS x FROM s) SELECT label, dim, round(sum(w * x) / sum(w), 6) AS pooled FROM p GROUP BY ALL")
def attention_pool(spark, sf_dir):
    out = metrics.attention_pool(emb(spark, sf_dir), ["label"], "v", F.get("v", F.lit(0)))
    return out.select("label", "dim", F.round("pooled", 6).alias("pooled"))


@query(f"WITH {E_SQL}, z AS (SELECT vec_id, label % 3 AS y, list_transform(v[1:3], lambda x: exp(x - list_max(v[1:3]))) AS x FROM e) SELECT vec_id, (list_position(x, list_max(x)) - 1)::INT AS best, round(x[1] / list_sum(x), 6) AS p0, round(-(0.95 * ln(x[y + 1] / list_sum(x)) + 0.05 * (ln(x[1] / list_sum(x)) + ln(x[2] / list_sum(x)) + ln(x[3] / list_sum(x))) / 3), 6) AS loss FROM z")
def softmax_loss(spark, sf_dir):
    from ..operators.scorer import argmax

    z = F.slice("v", 1, 3)
    p = metrics.softmax(z)
    return emb(spark, sf_dir).select("vec_id", argmax(p).alias("best"), F.round(F.get(p, F.lit(0)), 6).alias("p0"), F.round(metrics.cross_entropy(z, F.col("label") % 3), 6).alias("loss"))


# the cells (i, j) of a diagonal d = i + j follow from the two diagonals before it; the path is then walked back
DTW_SQL = """e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a, lead(list_transform(embedding, lambda x: x::DOUBLE)) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
p AS (SELECT * FROM e WHERE b IS NOT NULL),
g AS (SELECT vec_id, 0 AS d, [0.0::DOUBLE] || list_transform(range(1, 65), lambda i: 'inf'::DOUBLE) AS one, list_transform(range(0, 65), lambda i: 'inf'::DOUBLE) AS two FROM p UNION ALL
  SELECT g.vec_id, g.d + 1, list_transform(range(0, 65), lambda i: CASE WHEN i < 1 OR g.d + 1 - i < 1 OR g.d + 1 - i > 64 OR abs(2 * i - g.d - 1) > 9 THEN 'inf'::DOUBLE
    ELSE sqrt((p.a[i] - p.b[g.d + 1 - i]) * (p.a[i] - p.b[g.d + 1 - i])) + least(g.two[i], g.one[i], g.one[i + 1]) END), g.one FROM g JOIN p ON p.vec_id = g.vec_id WHERE g.d < 128),
w AS (SELECT vec_id, 64 AS i, 64 AS j, 0 AS steps FROM p UNION ALL
  SELECT vec_id, CASE WHEN s < 2 THEN i - 1 ELSE i END, CASE WHEN s = 1 THEN j ELSE j - 1 END, steps + 1 FROM (
    SELECT w.*, CASE WHEN h.two[w.i] <= least(h.one[w.i], h.one[w.i + 1]) THEN 0 WHEN h.one[w.i] <= h.one[w.i + 1] THEN 1 ELSE 2 END AS s FROM w JOIN g h ON h.vec_id = w.vec_id AND h.d = w.i + w.j - 1 WHERE w.i > 0 AND w.j > 0))"""


@query(f"WITH RECURSIVE {DTW_SQL} SELECT w.vec_id, max(w.steps)::INT AS steps, round(any_value(g.one[65]), 6) AS cost FROM w JOIN g ON g.vec_id = w.vec_id AND g.d = 128 GROUP BY w.vec_id")
def dtw_pairs(spark, sf_dir):
    e = emb(spark, sf_dir)
    p = e.withColumn("n", F.lead("v").over(Window.partitionBy("label").orderBy("vec_id"))).where("n IS NOT NULL")
    return align.dtw_pairs(p, "v", "n").select("vec_id", F.size("dtw.path").alias("steps"), F.round("dtw.cost", 6).alias("cost"))


@query()
def warp_average(spark, sf_dir):
    e = emb(spark, sf_dir).withColumn("e", F.transform("v", F.abs))
    w = Window.partitionBy("label").orderBy("vec_id")
    p = e.withColumn("nv", F.lead("v").over(w)).withColumn("ne", F.lead("e").over(w)).where("nv IS NOT NULL")
    return long_form(align.warp_contours(p, "v", "e", "nv", "ne", most=32), "warped_energy")


# ---- sorting, sampling, sets


@query("SELECT l_returnflag, l_orderkey, l_linenumber, rank FROM (SELECT *, (row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber))::INT AS rank FROM lineitem) WHERE rank <= 64")
def topk_per_group(spark, sf_dir):
    w = Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    cols = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return cols.withColumn("rank", F.row_number().over(w)).where("rank <= 64").select("l_returnflag", "l_orderkey", "l_linenumber", "rank")


@query("SELECT doc_id FROM (SELECT doc_id, md5('7:' || doc_id) AS h FROM documents ORDER BY h, doc_id LIMIT 100 OFFSET 50)")
def hash_sample_slice(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").withColumn("h", F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))))
    return d.orderBy("h", "doc_id").offset(50).limit(100).select("doc_id")


@query("SELECT doc_id, source, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 4)::INT AS slot FROM documents")
def round_robin(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.withColumn("slot", F.pmod(F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1, F.lit(4)))


@query("SELECT text FROM (SELECT role AS text FROM conversations UNION SELECT lang FROM documents) EXCEPT SELECT 'de'")
def set_operations(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").select(F.col("role").alias("text"))
    b = table(spark, sf_dir, "documents").select(F.col("lang").alias("text"))
    return a.unionByName(b).distinct().join(spark.createDataFrame([("de",)], "text string"), "text", "left_anti")


@query("SELECT user_id, count(DISTINCT event_type) AS labels, count(DISTINCT event_type) > 1 AS mixed FROM events GROUP BY user_id")
def distinct_labels(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("user_id").agg(F.count_distinct("event_type").alias("labels"))
    return e.withColumn("mixed", F.col("labels") > 1)


# ---- models and signal transforms


def weights(n: int):
    """Fixed weights of n classes for 64 features."""
    import numpy as np

    return np.random.default_rng(0).normal(size=(n, 64))


def _weights_sql(n: int) -> str:
    return "[" + ", ".join("[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in row) + "]" for row in weights(n)) + "]"


def linear(n: int):
    import numpy as np

    from ..operators import scorer

    return scorer.LinearScorer(weights(n), np.zeros(n))


@query(f"""WITH {E_SQL}, z AS (SELECT vec_id, 20 * log10(sqrt(list_avg(list_transform(v, lambda x: x * x))) + 1e-9) AS level, list_transform({_weights_sql(3)}, lambda w: list_sum(list_transform(range(1, 65), lambda i: w[i] * v[i]))) AS z FROM e)
SELECT vec_id, CASE WHEN level < -55 THEN 2 ELSE (list_position(z, list_max(z)) - 1)::INT END AS label FROM z""")
def scored_labels(spark, sf_dir):
    from ..operators import scorer

    out = scorer.score(emb(spark, sf_dir), "v", linear(3), skip=S.dbfs(F.col("v")) < -55)
    return out.select("vec_id", F.coalesce(scorer.argmax(F.col("scores")), F.lit(2)).alias("label"))


@query(f"""WITH {E_SQL}, z AS (SELECT vec_id, (label % 2)::INT AS y, list_transform({_weights_sql(2)}, lambda w: list_sum(list_transform(range(1, 65), lambda i: w[i] * v[i]))) AS z FROM e),
x AS (SELECT vec_id, y, round(1 / (1 + exp(z[1] - z[2])), 9) AS score FROM z), s AS (SELECT *, (row_number() OVER w)::BIGINT AS rank, sum(1 - y) OVER w / greatest(1, sum(1 - y) OVER ())::DOUBLE AS fpr,
  1 - sum(y) OVER w / greatest(1, sum(y) OVER ())::DOUBLE AS fnr FROM x WINDOW w AS (ORDER BY score DESC, vec_id)),
c AS (SELECT *, CASE WHEN fpr - fnr < 0 THEN 1 ELSE 0 END AS neg, lead(CASE WHEN fpr - fnr < 0 THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS nxt FROM s),
p AS (SELECT * FROM c WHERE neg <> nxt ORDER BY rank LIMIT 1), q AS (SELECT * FROM c ORDER BY abs(fpr - fnr), rank LIMIT 1), u AS (SELECT * FROM p UNION ALL SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM p))
SELECT round((fpr + fnr) / 2, 9) AS eer, round(score, 6) AS threshold FROM u""")
def evaluate_eer(spark, sf_dir):
    from ..operators import scorer

    scored = scorer.score(emb(spark, sf_dir), "v", linear(2)).select("vec_id", F.round(F.get("scores", F.lit(1)), 9).alias("score"), (F.col("label") % 2).alias("y"))
    return metrics.eer(metrics.eer_sweep(scored, "score", "y", "vec_id")).select(F.round("eer", 9).alias("eer"), F.round("threshold", 6).alias("threshold"))


@query()
def cepstra(spark, sf_dir):
    from ..operators import dsp

    out = dsp.on_clips(emb(spark, sf_dir), "v", lambda x: dsp.lfcc(x, 1000, 10, 12, 32, 8), "y", matrix=True)
    return out.select("vec_id", F.size("y").alias("frames"), F.round(F.aggregate(F.flatten("y"), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query()
def denoised(spark, sf_dir):
    from ..operators import dsp

    out = dsp.on_clips(emb(spark, sf_dir), "v", lambda x: dsp.spectral_subtraction(x, 16, 4), "y")
    return out.select("vec_id", F.size("y").alias("n"), F.round(S.peak(F.col("y")), 6).alias("peak"))
