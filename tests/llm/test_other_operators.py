"""Nearest neighbours, mixing, and the pipeline."""

import json
import math
import os
import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lexiframe.llm import ann, mixing


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[7] = x[3]
    x[50] = 2 * x[100]
    rows = [(i, [float(v) for v in x[i]], "z") for i in range(600)]
    rows += [(1000, None, "z"), (1050, [0.0] * 16, "z"), (1100, [float("nan")] + [1.0] * 15, "z"), (1150, [None] + [1.0] * 15, "z"), (1200, [1.0] * 4, "z"), (None, [1.0] * 16, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = {}
    for r in ann.neighbours(spark, df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 50))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in got:
        s = u @ u[q]
        s[q] = -2
        want = s[np.argsort(-s, kind="stable")[:5]]
        g = sorted(got[q])
        assert [r for r, _, _ in g] == [1, 2, 3, 4, 5]
        assert all(abs(s[v] - c) < 1e-12 for _, v, c in g)
        hit += sum(c >= want[-1] - 1e-12 for _, _, c in g)
    assert hit / (5 * len(got)) >= 0.9
    assert sorted(got[50])[0][1] == 100
    assert ann.neighbours(spark, df.limit(0)).count() == 0


def test_equal_vectors_tie_by_id(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(120)], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.neighbours(spark, df).collect())
    assert [v for q, _, v in got if q == 0] == [1, 2, 3, 4, 5] and [v for q, _, v in got if q == 50] == [0, 1, 2, 3, 4]


def level(b, nodes):
    """Water filling by bisection-free reference: raise all unsaturated nodes together."""
    given, open_ = {k: 0.0 for k in nodes}, {k for k, (w, c) in nodes.items() if w > 0}
    while open_ and b > 1e-9:
        total = sum(nodes[k][0] for k in open_)
        step = min(b / total, *((nodes[k][1] - given[k]) / nodes[k][0] for k in open_))
        for k in open_:
            given[k] += step * nodes[k][0]
        b -= step * total
        open_ = {k for k in open_ if nodes[k][1] - given[k] > 1e-9}
    return given


def test_mixing_budgets_and_prefixes(spark):
    rows = []
    for i in range(300):
        lang, source = ("en", "de")[i % 2], f"s{i % 6}"
        rows.append((i, " ".join(["w"] * (1 + (i * 7) % 40)), "big" if i % 3 == 0 else "small", lang, source if i % 7 else None, "x"))
    rows += [(900, None, "big", "en", "s0", "x"), (901, "", "big", "en", "s0", "x"), (902, "a b c", None, None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string, given string")
    weights = [mixing.weight(F.col("domain"), {"big": 3, "small": 1}, 0), mixing.weight(F.col("lang"), {"en": 2}, 1), F.lit(1).cast("long")]
    got = mixing.mix(spark, docs, ["domain", "lang", "source"], weights, budget=6000, max_epochs=2).collect()
    size = {}
    for i, t, d, g, s, _ in rows:
        n = len((t or "").split())
        if n:
            size[(d or "", g or "", s or "")] = size.get((d or "", g or "", s or ""), 0) + n
    cap = {k: 2 * v for k, v in size.items()}
    want = {}
    top = level(6000, {d: ({"big": 3, "small": 1}.get(d, 0), sum(c for k, c in cap.items() if k[0] == d)) for d in {k[0] for k in cap}})
    for d in top:
        mid = level(top[d], {g: (2 if g == "en" else 1, sum(c for k, c in cap.items() if k[:2] == (d, g))) for g in {k[1] for k in cap if k[0] == d}})
        for g in mid:
            leaf = level(mid[g], {k[2]: (1, cap[k]) for k in cap if k[:2] == (d, g)})
            want |= {(d, g, s): v for s, v in leaf.items()}
    taken = {}
    for r in got:
        taken[r.domain, r.lang, r.source] = taken.get((r.domain, r.lang, r.source), 0) + r.taken
    for k, v in want.items():
        assert abs(taken.get(k, 0) - math.floor(v + 1e-6)) <= 1, (k, v, taken.get(k))
    assert all(0 <= r.cut <= r.n_tokens and r.taken == r.epochs * r.n_tokens + r.cut for r in got)
    partial = {}
    for r in got:
        if 0 < r.cut < r.n_tokens:
            partial[r.domain, r.lang, r.source] = partial.get((r.domain, r.lang, r.source), 0) + 1
    assert all(n == 1 for n in partial.values())
    again = mixing.mix(spark, docs.repartition(7), ["domain", "lang", "source"], weights, budget=6000, max_epochs=2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mixing.mix(spark, docs.limit(0), ["domain", "lang", "source"], weights).count() == 0


def test_pipeline_keeps_clean_documents_and_schema(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf_dir)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS, name
        path = f"/tmp/lexiframe-test-{os.getpid()}-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        assert 0 < docs.count() <= before
        if name != "near_duplicates":
            assert docs.count() >= 0.7 * before
        before = docs.count()
    assert docs.where(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in last} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert json.dumps([r.doc_id for r in last[:3]])


def test_pipeline_tells_rows_without_a_single_id_apart(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, text(1)), (2, text(2)), (2, text(2)), (3, text(3)), (3, text(1)), (None, text(4)), (None, text(5)), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(1, text(1)), (2, text(2)), (3, text(3)), (None, text(4)), (None, text(5)), (None, None)], key=repr)


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty and long texts, repeated ids, copies, passages and personal data through all stages; then an empty table."""
    r = random.Random(4)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    item, copy, long = prose(30), prose(80), prose(25_000)
    rows = [(1, None), (2, ""), (3, " \n"), (4, copy), (5, copy), (6, prose(900) + " " + item[:200] + " " + prose(900)), (7, prose(40) + " me@mail.example.com " + prose(20)), (8, long), (9, prose(50)), (9, prose(51)), (None, prose(52)), (10, "x" * 50_000)]
    rows = [(i, t, None if i == 9 else "en", None if i == 7 else "src1", None if i == 8 else len(t or "")) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    def put(name, data, kind):
        spark.createDataFrame(data, kind).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")

    put("documents", rows, schema)
    put("labels", [(4, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    put("benchmark", [(1, item), (2, None), (3, ""), (None, item)], "item_id long, text string")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("hits", F.lit(1)).withColumn("spans", F.lit("s"))
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, str(tmp_path))
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(out.collect(), out.schema)
    kept = [(x.doc_id, x.text) for x in docs.collect()]
    assert sorted(i for i, _ in kept if i is not None) == [1, 2, 3, 4, 7, 8, 9, 9, 10] and len(kept) == 10
    assert [t for i, t in kept if i == 7][0].split()[40] == "[EMAIL]" and [t for i, t in kept if i == 8] == [long] and [t for i, t in kept if i == 1] == [None]
    last = corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()
    assert {x.doc_id for x in last} <= {4, 7, 8, 9, 10, None}
    assert all(len(x.text.split()) == (x.n_tokens if x.epochs else x.cut) and x.n_chars == len(x.text) for x in last)
    put("documents", [], schema)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_passages_of_a_benchmark_are_found_as_by_brute_force(spark, sf_dir):
    """The stage drops what holds thirteen words in a row of an item, or of a shorter item a twentieth of its words."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    grams = {tuple(w[k : k + 13]) for w in (words(x.text) for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()) if len(w) >= 13 for k in range(len(w) - 12)}
    want = set()
    for x in docs.collect():
        w = words(x.text)
        if not any(tuple(w[k : k + 13]) in grams for k in range(len(w) - 12)):
            want.add(x.doc_id)
    assert {x.doc_id for x in corpus_pipeline.drop_contaminated(spark, docs, sf_dir).collect()} == want


def test_vectors_count_as_given(spark):
    """Doubles are not cut to floats, and queries of one vector are answered each."""
    rows = [(i, [1e100, float(i % 7) * 1e100 + 1e90]) for i in range(140)] + [(200 + i, [1.0 + 1e-12 * i, 2.0]) for i in range(10)]
    got = {}
    for r in ann.neighbours(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query="id % 10 = 0").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(got) == set(range(0, 140, 10)) | {200}
    assert [v for _, v in sorted(got[70])] == [0, 7, 14, 21, 28] and [v for _, v in sorted(got[0])] == [7, 14, 21, 28, 35]
