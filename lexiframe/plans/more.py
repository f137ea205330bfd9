"""Registered queries of sources, compositions and evaluation, each with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import signal as S
from ..functions import text as X
from ..operators import dictionary, evaluate, generate, lm, metrics, timeline
from ..sources import io
from .registry import CODE_SQL, E_SQL, MODEL_SQL, KEY, ORDER, _long_sql, _weights_sql, code, emb, events, linear, long_form, query, table, user_segments

# ---- sources and sinks: written to the shared folder and read again


@query(f"""WITH {E_SQL}, s AS (SELECT vec_id, v, greatest(1.0, list_max(list_transform(v, lambda x: abs(x)))) AS p FROM e)
SELECT vec_id, 8000 AS sr, len(v)::INT AS n, list_sum(list_transform(v, lambda x: round_even(x / p * 32767, 0)))::BIGINT AS total FROM s""")
def wav_round_trip(spark, sf_dir):
    where = io.scratch_dir(spark)
    io.write_wav(emb(spark, sf_dir).select(F.col("vec_id").alias("clip_id"), "v"), where, "v", 8000)
    back = io.read_wav(spark, where, rate=None)
    total = F.aggregate(F.transform("samples", lambda x: F.round(x.cast("double") * 32768, 0)), F.lit(0.0), lambda s, x: s + x)
    return back.select(F.regexp_extract("clip_id", r"(\d+)\.wav$", 1).cast("long").alias("vec_id"), "sr", F.size("samples").alias("n"), total.cast("long").alias("total"))


@query(f"WITH {E_SQL} SELECT vec_id, 8000 AS sr, round(len(v) / 8000.0, 9)::DOUBLE AS seconds, (44 + 2 * len(v))::BIGINT AS length FROM e")
def wav_headers(spark, sf_dir):
    where = io.scratch_dir(spark)
    io.write_wav(emb(spark, sf_dir).select(F.col("vec_id").alias("clip_id"), "v"), where, "v", 8000)
    number = F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("vec_id")
    info = io.wav_info(spark, where).select(number, "sr", F.round("seconds", 9).alias("seconds"))
    return info.join(io.list_files(spark, where, "*.wav").select(number, "length"), "vec_id")


@query(f"WITH {E_SQL} SELECT vec_id, vec_id % 3 = 0 AS inline, len(v)::INT AS n FROM e WHERE vec_id % 3 <> 1")
def decode_path_or_bytes(spark, sf_dir):
    """Clips come under a path, with the row, or broken; these give no row."""
    where = io.scratch_dir(spark)
    io.write_wav_table(emb(spark, sf_dir).select(F.col("vec_id").alias("clip_id"), "v"), where, "v", 8000)
    rows = spark.read.parquet(where)
    kind = F.col("clip_id") % 3
    rows = rows.select("clip_id", F.when(kind == 2, F.col("wav")).alias("content"), F.when(kind == 0, F.col("wav")).when(kind == 1, F.encode(F.lit("no clip"), "UTF-8")).alias("wav"))
    out = io.decode_clips(rows, rate=None)
    return out.select(F.col("clip_id").cast("long").alias("vec_id"), (F.col("clip_id").cast("long") % 3 == 0).alias("inline"), F.size("samples").alias("n"))


@query(f"""WITH s AS (SELECT user_id, row_number() OVER w AS seg, (epoch_us(ts) // 1000000 % 86400) / 4.0::DOUBLE AS start_s, {CODE_SQL} AS label FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT 'u' || user_id AS wav, (seg - 1)::INT AS i, start_s, start_s + 0.5::DOUBLE AS end_s, 'L' || label AS label FROM s""")
def manifest_round_trip(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("seg", F.row_number().over(Window.partitionBy(*KEY).orderBy(*ORDER)))
    start = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) % 86400) / 4.0
    e = e.select("user_id", "seg", F.struct(start.alias("start_s"), (start + 0.5).alias("end_s"), F.concat(F.lit("L"), code().cast("string")).alias("label")).alias("x"))
    m = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", "x"))), lambda s: s["x"]).alias("segments"))
    where = io.scratch_dir(spark)
    io.write_manifest(m.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("wav"), "segments"), where)
    return io.read_manifest(spark, where).select("wav", F.posexplode("segments").alias("i", "x")).select("wav", "i", "x.*")


@query("""SELECT key, ol, gloss FROM (SELECT p_name AS key, min(p_brand) AS ol, min(p_type) AS gloss FROM part GROUP BY 1)""")
def dictionary_round_trip(spark, sf_dir):
    d = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("key")).agg(F.min("p_brand").alias("ol"), F.min("p_type").alias("gloss"))
    where = io.scratch_dir(spark)
    io.write_dictionary(d.select("key", "ol", F.col("ol").alias("deva"), F.col("ol").alias("hi"), "gloss"), where)
    return io.read_dictionary(spark, where).select("key", "ol", "gloss")


@query(f'WITH {MODEL_SQL} SELECT "order"::INT AS "order", count(*) AS grams, sum(c)::BIGINT AS total, (SELECT v FROM dn)::BIGINT AS denominator FROM gr GROUP BY 1')
def model_round_trip(spark, sf_dir):
    where = io.scratch_dir(spark)
    io.save_model(lm.fit(table(spark, sf_dir, "benchmark")), where)
    m = io.load_model(spark, where)
    return m.ngram.groupBy(F.col("order").cast("int").alias("order")).agg(F.count("*").alias("grams"), F.sum("c").alias("total")).withColumn("denominator", F.lit(m.denominator).cast("long"))


@query(f"WITH {E_SQL} SELECT vec_id, i - 1 AS i, round(v[i], 6) AS v FROM e, range(11, 21) t(i)")
def sample_ranges(spark, sf_dir):
    """A range of each clip's samples: a filter that reaches the scan of the written table."""
    where = io.scratch_dir(spark)
    io.explode_samples(emb(spark, sf_dir).select(F.col("vec_id").alias("clip_id"), F.col("v").alias("samples"))).write.parquet(where)
    return spark.read.parquet(where).where("i >= 10 AND i < 20").select(F.col("clip_id").alias("vec_id"), F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


# ---- the built-in sentences


@query('SELECT "order", types, d::DOUBLE AS d FROM (VALUES (1, 397::BIGINT, 0.721823), (2, 653::BIGINT, 0.917282), (3, 678::BIGINT, 0.976642)) v("order", types, d)')
def syllabus_model(spark, sf_dir):
    """The built-in model's published sizes and discounts."""
    return lm.build_syllabus_lm(spark).meta.select(F.col("order").cast("int").alias("order"), "types", F.round("d", 6).alias("d"))


@query("SELECT count(*) AS sentences, 73 + (SELECT count(*) FROM benchmark) AS texts FROM range(73)")
def syllabus_texts(spark, sf_dir):
    n = dictionary.lecture_sentences(spark).agg(F.count("*").alias("sentences"))
    extra = table(spark, sf_dir, "benchmark").select("text")
    both = dictionary.lecture_sentences(spark).select("text").unionByName(extra).agg(F.count("*").alias("texts"))
    return n.join(both)


# ---- evaluation


@query(f"""WITH {E_SQL}, z AS (SELECT vec_id, vec_id % 50 AS clip, CASE WHEN vec_id % 7 > 0 THEN label % 3 END AS y, v[1:3] AS z FROM e),
p AS (SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS x FROM z), f AS (SELECT -(0.95 * ln(x[y + 1] / list_sum(x)) + 0.05 * list_avg(list_transform(x, lambda q: ln(q / list_sum(x))))) AS l FROM p WHERE y IS NOT NULL),
u AS (SELECT clip, [avg(z[1]), avg(z[2]), avg(z[3])] AS z FROM z GROUP BY clip), q AS (SELECT clip, list_transform(z, lambda x: exp(x - list_max(z))) AS x FROM u),
g AS (SELECT -(0.95 * ln(x[clip % 3 + 1] / list_sum(x)) + 0.05 * list_avg(list_transform(x, lambda q: ln(q / list_sum(x))))) AS l FROM q)
SELECT round(0.7 * (SELECT avg(l) FROM f) + 0.3 * (SELECT avg(l) FROM g), 6) AS loss""")
def multitask_loss(spark, sf_dir):
    z = emb(spark, sf_dir).select((F.col("vec_id") % 50).alias("clip"), F.when(F.col("vec_id") % 7 > 0, F.col("label") % 3).alias("y"), F.slice("v", 1, 3).alias("z"))
    frames = z.select(metrics.cross_entropy(F.col("z"), F.col("y")).alias("frame"), F.lit(None).cast("double").alias("utterance"))
    u = z.groupBy("clip").agg(F.array(*[F.avg(F.get("z", F.lit(k))) for k in range(3)]).alias("z"))
    u = u.select(F.lit(None).cast("double").alias("frame"), metrics.cross_entropy(F.col("z"), F.col("clip") % 3).alias("utterance"))
    return frames.unionByName(u).agg(F.round(metrics.multitask_loss(F.col("frame"), F.col("utterance")), 6).alias("loss"))


@query(f"WITH {E_SQL} SELECT label AS epoch, count(*) AS rows, round(avg(v[1] * v[1]), 6) AS mean FROM e GROUP BY label")
def loss_log(spark, sf_dir):
    rows = emb(spark, sf_dir).select(F.col("label").alias("epoch"), (F.get("v", F.lit(0)) * F.get("v", F.lit(0))).alias("loss"))
    return metrics.loss_log(rows, ["epoch"], "loss").withColumn("mean", F.round("mean", 6))


@query("""SELECT DISTINCT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 5 ELSE 2 END AS fields FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations WHERE text IS NOT NULL) WHERE trim(ref) <> ''""")
def error_report(spark, sf_dir):
    """Whole reports of turns against the turn before; on even conversations two languages were heard."""
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL").withColumn("ref", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("trim(ref) <> ''")
    heard = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("EN"), F.lit("HI"))).otherwise(F.array(F.lit("EN")))
    out = c.withColumn("report", metrics.error_report(F.col("ref"), F.col("text"), X.split_words, heard))
    return out.select("conv_id", "turn", F.size(F.json_object_keys("report")).alias("fields"))


_ROBUST = f"""{E_SQL}, g AS (SELECT vec_id, v, {_weights_sql(2)} AS w FROM e),
h AS (SELECT vec_id, v, w, list_sum(list_transform(v, lambda x: x * x)) AS power, list_transform(range(1, 65), lambda i: sign(w[1][i] - w[2][i])) AS s FROM g),
b AS (SELECT vec_id, 0 AS k, 1e-5::DOUBLE AS lo, 0.1::DOUBLE AS hi, false AS hit FROM h UNION ALL
  SELECT vec_id, k + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END, hit OR ok FROM (
    SELECT b.*, list_sum(list_transform(range(1, 65), lambda i: (h.w[2][i] - h.w[1][i]) * greatest(-1, least(1, h.v[i] - (b.lo + b.hi) / 2 * h.s[i])))) > 0
      AND 10 * log10((h.power + 1e-12) / (list_sum(list_transform(range(1, 65), lambda i: power(greatest(-1, least(1, h.v[i] - (b.lo + b.hi) / 2 * h.s[i])) - h.v[i], 2))) + 1e-12)) >= 40 AS ok FROM b JOIN h ON h.vec_id = b.vec_id WHERE b.k < 18)),
r AS (SELECT b.vec_id, b.hi AS epsilon, list_sum(list_transform(range(1, 65), lambda i: (h.w[2][i] - h.w[1][i]) * greatest(-1, least(1, h.v[i] - b.hi * h.s[i])))) > 0 AS flipped,
  10 * log10((h.power + 1e-12) / (list_sum(list_transform(range(1, 65), lambda i: power(greatest(-1, least(1, h.v[i] - b.hi * h.s[i])) - h.v[i], 2))) + 1e-12)) AS snr_db FROM b JOIN h ON h.vec_id = b.vec_id WHERE b.k = 18)"""


@query(f"WITH RECURSIVE {_ROBUST} SELECT vec_id, round(epsilon, 9) AS epsilon, flipped, round(snr_db, 6) AS snr_db FROM r")
def robustness_search(spark, sf_dir):
    """The step towards class 1 follows the sign of the loss's gradient, which for two classes is that of the weights' difference."""
    from ..operators import scorer

    out = scorer.robustness(emb(spark, sf_dir), "v", linear(2), 1).select("vec_id", "robustness.*")
    return out.select("vec_id", F.round("epsilon", 9).alias("epsilon"), "flipped", F.round("snr_db", 6).alias("snr_db"))


# ---- signals and timelines


@query(_long_sql("list_transform(range(0, 100), lambda k: v[(k * (len(v) - 1) // 99)::INT + 1])"))
def regrid_contour(spark, sf_dir):
    return long_form(emb(spark, sf_dir).withColumn("y", S.regrid(F.col("v"), 100)))


@query("SELECT doc_id, CASE WHEN n_chars >= 5 THEN ((n_chars - 5) // 30 + 1)::INT ELSE 0 END AS windows, CASE WHEN n_chars >= 5 THEN ((n_chars - 5) // 30 * 30)::DOUBLE END AS last FROM documents")
def stride_windows(spark, sf_dir):
    """Windows of 5 every 30, with characters as seconds."""
    d = table(spark, sf_dir, "documents").select("doc_id", timeline.strides(F.col("n_chars").cast("double")).alias("w"))
    return d.select("doc_id", F.size("w").alias("windows"), F.try_element_at("w", F.lit(-1)).alias("last"))


@query("""WITH p AS (SELECT user_id, (row_number() OVER w - 1) * 30.0::DOUBLE AS t, CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END AS hi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT user_id, t, round(avg(hi) OVER w, 12) AS mean, count(*) OVER w AS k FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT user_id, arg_max(t, (mean, -t)) AS start, max(mean) AS mean FROM f WHERE k = 5 GROUP BY user_id""")
def probe_windows(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("t", (F.row_number().over(Window.partitionBy(*KEY).orderBy(*ORDER)) - 1) * 30.0)
    p = e.select("user_id", "t", (100 - F.col("value")).alias("p_en"), F.when(F.col("value") >= 50, F.lit(101.0)).otherwise(F.lit(-1.0)).alias("p_hi"))
    return evaluate.probe_windows(p, KEY, 5)


@query("""SELECT vec_id, k::INT AS chunk, least(20, 64 - 20 * k)::INT AS n, round(list_sum(list_transform(embedding[20 * k + 1:least(64, 20 * k + 20)], lambda x: x::DOUBLE)), 5) AS total FROM embeddings, range(4) t(k) WHERE least(20, 64 - 20 * k) >= 4""")
def clip_chunks(spark, sf_dir):
    """Pieces of 20 samples; a tail is kept from 4 samples on."""
    clips = emb(spark, sf_dir).select(F.col("vec_id").alias("clip_id"), F.lit(10).alias("sr"), F.col("v").alias("samples"))
    out = evaluate.chunks(clips, 2.0, least_s=0.4)
    return out.select(F.col("clip_id").alias("vec_id"), "chunk", F.size("samples").alias("n"), F.round(S.total(F.col("samples")), 5).alias("total"))


@query("""WITH c AS (SELECT vec_id, 20 * k AS i, list_sum(list_transform(embedding[20 * k + 1:least(64, 20 * k + 20)], lambda x: x::DOUBLE)) AS s, k FROM embeddings, range(4) t(k) WHERE least(20, 64 - 20 * k) >= 10)
SELECT vec_id, string_agg(CASE WHEN s > 0 THEN 'up' ELSE 'down' END, ' ' ORDER BY k) AS text FROM c GROUP BY vec_id""")
def transcribe_chunks(spark, sf_dir):
    """Chunked transcription with a scorer that says which way a chunk leans; tails under a second are dropped."""
    clips = emb(spark, sf_dir).select(F.col("vec_id").alias("clip_id"), F.lit(10).alias("sr"), F.col("v").alias("samples"))
    said = lambda c: c.select("clip_id", "chunk", F.when(S.total(F.col("samples")) > 0, " up ").otherwise("down").alias("text"))
    return evaluate.transcribe(clips, said, 2.0).select(F.col("clip_id").alias("vec_id"), "text")


@query("SELECT vec_id FROM embeddings WHERE len(embedding) / 20.0 >= 3 ORDER BY vec_id LIMIT 100")
def prepare_clips(spark, sf_dir):
    clips = emb(spark, sf_dir).select(F.col("vec_id").alias("clip_id"), F.lit(20).alias("sr"), F.col("v").alias("samples"))
    return evaluate.prepare(clips, 100, 3.0, seed=None).select(F.col("clip_id").alias("vec_id"))


@query("SELECT doc_id, (n_chars % 7 * 220)::INT AS n, 0.0::DOUBLE AS peak FROM documents WHERE n_chars % 7 > 0")
def silences(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("n_chars % 7 > 0").select("doc_id", S.silence((F.col("n_chars") % 7) / 100.0, 22000).alias("v"))
    return d.select("doc_id", F.size("v").alias("n"), F.array_max(F.transform("v", F.abs)).alias("peak"))


@query(f"""WITH s AS (SELECT user_id, (row_number() OVER w)::BIGINT AS seg, (epoch_us(ts) // 1000000 % 86400) / 100.0::DOUBLE AS start_s, {CODE_SQL} AS label FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT label, round(sum((start_s + 0.05::DOUBLE) - start_s), 6) AS seconds FROM s GROUP BY label""")
def seconds_per_label(spark, sf_dir):
    return evaluate.seconds_per_label(user_segments(spark, sf_dir)).withColumn("seconds", F.round("seconds", 6))


# ---- text


@query("SELECT doc_id, sha256(nfc_normalize(coalesce(text, ''))) AS digest FROM documents")
def normal_form(spark, sf_dir):
    """Form C of texts whose accents were taken apart first."""
    import unicodedata

    apart = "áàâäéèêëíìîïóòôöúùûüñçÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜÑÇ"
    t = F.coalesce(F.col("text"), F.lit(""))
    for c in apart:
        t = F.replace(t, F.lit(c), F.lit(unicodedata.normalize("NFD", c)))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.nfc(t), 256).alias("digest"))


@query("""SELECT doc_id, array_to_string(list_transform(string_split(text[1:200], ''), lambda c: CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) < 256 THEN '\\x' || format('{:02x}', unicode(c)) ELSE '\\u' || format('{:04x}', unicode(c)) END), '') AS shown
FROM documents WHERE text <> '' AND coalesce(list_max(list_transform(string_split(text[1:200], ''), lambda c: unicode(c))), 0) < 65536""")
def previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", X.preview(F.col("text"), 200).alias("shown"))


@query("""SELECT conv_id, turn, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ ]+'), lambda x: length(trim(x)) >= 2))::INT AS kept FROM conversations""")
def speakable_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.size(X.speakable(F.split(F.coalesce("text", F.lit("")), "[ ]+", -1))).alias("kept"))


@query("SELECT list_transform(range(0, 3), lambda k: k)[i + 1] AS clip, 2 AS labels FROM range(3) t(i)")
def tone_timelines(spark, sf_dir):
    """Seeded clips of alternating tones hold both labels and no others."""
    segs = spark.range(3).select(F.col("id").alias("clip"), generate.tone_segments(F.col("id").cast("string"), 7, 60.0).alias("s"))
    return segs.select("clip", F.size(F.array_intersect(F.array_distinct(F.transform("s", lambda x: x["label"])), F.array(F.lit("EN"), F.lit("HI")))).alias("labels"))
