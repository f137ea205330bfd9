"""Generators and compositions."""

import numpy as np
from pyspark.sql import functions as F

from lexiframe.operators import dsp, evaluate, generate


def test_synthetic_clips_are_labelled_tones(spark):
    rows = generate.synthetic_clips(spark, 3, seconds=2.0, rate=8000).collect()
    again = generate.synthetic_clips(spark.newSession(), 3, seconds=2.0, rate=8000).repartition(2).collect()
    assert {r.clip_id: r.segments for r in rows} == {r.clip_id: r.segments for r in again}
    for r in rows:
        s = r.segments
        assert s[0].start_s == 0 and all(a.end_s == b.start_s for a, b in zip(s, s[1:])) and s[-1].end_s > 1.7 and len(r.samples) == 16000
        x = np.array(r.samples)[: int(s[0].end_s * 8000)]
        assert abs(np.median(dsp.f0(x, 8000)) - (200 if s[0].label == "EN" else 310)) < 15


def test_timelines(spark):
    d = F.array(F.lit(2.0), F.lit(12.0), F.lit(4.0))
    a = spark.range(1).select(generate.alternating_timeline(d, 30.0)).first()[0]
    assert [s.label for s in a[:4]] == ["EN", "SIL", "HI", "SIL"] and a[-1].end_s >= 30 and all(s.end_s - s.start_s <= 8 + 1e-9 for s in a)
    m = spark.range(1).select(generate.mixed_timeline(F.lit("c"), d, 40.0)).first()[0]
    assert m[0].label == "SIL" and m[-1].end_s >= 40 and all(abs(x.end_s - y.start_s) < 1e-9 for x, y in zip(m, m[1:]))
    assert spark.range(1).select(generate.mixed_timeline(F.lit("c"), F.array().cast("array<double>"), 40.0)).first()[0] == []


def test_evaluation_of_a_timeline(spark):
    frames = [("c", i, [0.9, 0.1, 0.0] if i < 50 else [0.1, 0.9, 0.0], -80.0 if 20 <= i < 40 or i == 70 else -10.0) for i in range(100)]
    f = spark.createDataFrame(frames, "clip string, frame_idx long, scores array<double>, level double")
    p = evaluate.predict_frames(f, ["clip"], "scores", "level")
    got = {r.frame_idx: r.label for r in p.collect()}
    assert [got[i] for i in (0, 19, 20, 39, 40, 60, 70)] == [0, 0, 2, 2, 0, 1, 1]
    seg = spark.createDataFrame([("c", 0, 0.0, 0.5, 0), ("c", 1, 0.5, 1.0, 1)], "clip string, seg int, start_s double, end_s double, label int")
    cells, f1 = evaluate.evaluate(p, seg, ["clip"], [0, 1, 2])
    assert {(r.truth, r.pred): r.n for r in cells.collect() if r.n} == {(0, 0): 30, (0, 2): 20, (1, 1): 50} and abs(f1.first()[0] - (0.75 + 1) / 3) < 1e-9


def test_chunks_and_transcription(spark):
    c = spark.createDataFrame([("a", 10, [float(i) for i in range(25)])], "clip_id string, sr int, samples array<float>")
    assert [len(r.samples) for r in evaluate.chunks(c, 1.0).orderBy("chunk").collect()] == [10, 10, 5]
    assert evaluate.chunks(c, 1.0, keep_tail=False).count() == 2
    t = evaluate.transcribe(c, lambda d: d.select("clip_id", "chunk", F.concat(F.lit("w"), F.col("chunk").cast("string")).alias("text")), 1.0)
    assert t.first().text == "w0 w1"
    probes = spark.createDataFrame([("a", float(i), 0.5, 0.9 if 3 <= i < 6 else 0.1) for i in range(10)], "k string, t double, p_en double, p_hi double")
    assert evaluate.probe_windows(probes, ["k"], 3).first().start == 3.0
    assert evaluate.prepare(c, 5, 2.0).count() == 1 and evaluate.prepare(c, 5, 3.0).count() == 0
