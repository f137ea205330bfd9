"""Pinned cases and properties of operators without SQL of their own."""

import math
import wave

import numpy as np
from pyspark.sql import functions as F

from lexiframe.functions import signal as S
from lexiframe.functions import text as X
from lexiframe.operators import align, dictionary, dsp, lm, metrics, scorer, timeline
from lexiframe.sources import io


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def floats(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_pronunciation(spark):
    say = lambda s: one(spark, X.text_to_ipa(F.lit(s)))[0]
    assert say("but, i'll never be lacking in my efforts.") == "bʌt·,·ɪll·nɛvɛr·bɛ·lækɪŋ·ɪn·mi·ɛffɒrts·."
    assert say("14th grade") == "θ·ɡrædɛ" and say("कमल") == "kməl" and say("") == ""


def test_script_conversion(spark):
    to = lambda s: one(spark, X.ipa_to_devanagari(F.lit(s)))[0]
    assert to("bʌt·,·ɪll·nɛvɛr·bɛ·lækɪŋ·.") == "बट , इलअल नैवैर बै लैकिङ ." and to("bʌt") == "बटअ"


def test_tokenisers(spark):
    assert one(spark, X.lm_tokens(F.lit("IT'S it's 42x")))[0] == ["it", "s", "it's", "42", "x"]
    assert one(spark, X.shingles(F.split(F.lit("a b"), " "), 3))[0] == []


def test_packing(spark):
    text = ". ".join(["x" * 150, "y" * 150, "z" * 150, "w" * 500, "v"])
    got = one(spark, X.pack_chunks(F.lit(text)))[0]
    assert [len(g) for g in got] == [303, 151, 501, 2] and one(spark, X.pack_chunks(F.lit("")))[0] == [""]


def test_dictionary(spark):
    d = dictionary.full_dictionary(spark)
    assert d.count() == 500 and d.orderBy(F.desc("ord")).first().key == "embedding_state" and dictionary.lecture_sentences(spark).count() == 73
    t = spark.createDataFrame([(1, "the problem. is"), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.translation for r in dictionary.translate(t, d, ["id"], target="deva").collect()}
    assert got == {1: "the जाहान is", 2: "", 3: ""}


def test_language_model_statistics(spark, tmp_path):
    model = lm.fit(dictionary.lecture_sentences(spark))
    meta = {r.order: r for r in model.meta.collect()}
    assert [meta[k].types for k in (1, 2, 3)] == [397, 653, 678]
    assert [round(meta[k].d, 6) for k in (1, 2, 3)] == [0.721823, 0.917282, 0.976642]
    io.save_model(model, str(tmp_path / "model"))
    back = io.load_model(spark, str(tmp_path / "model"))
    texts = spark.createDataFrame([(1, "the mel spectrum"), (2, "")], "id int, text string")
    a, b = (sorted((r.id, r.n, round(r.score, 9)) for r in lm.score_sequences(m, texts, ["id"]).collect()) for m in (model, back))
    assert a == b and all(s < 0 for _, _, s in a)


def test_boundary_matching(spark):
    got = metrics.boundary_f1(spark.createDataFrame([(1, [], []), (2, [1], []), (3, [5, 6], [5]), (4, [10, 12], [11, 13])], "k int, pred array<bigint>, truth array<bigint>"), ["k"], tolerance=1)
    assert [(r.k, r.matched, r.f1) for r in got.orderBy("k").collect()] == [(1, 0, 1.0), (2, 0, 0.0), (3, 1, 2 / 3), (4, 2, 1.0)]


def test_error_rates(spark):
    a, b = F.split(F.lit("a b c d"), " "), F.split(F.lit("a x c"), " ")
    assert one(spark, metrics.wer(a, b))[0] == 0.5 and one(spark, metrics.cer(F.lit("abcd"), F.lit("abd")))[0] == 0.25
    assert one(spark, metrics.wer(F.array().cast("array<string>"), b))[0] is None


def test_timeline_cases(spark):
    e = spark.createDataFrame([("a", i, v) for i, v in enumerate([2, 2, 0, 0, 1])], "k string, t long, label int")
    assert [(r.t, r.label) for r in timeline.switches(e, ["k"], ["t"], "label").orderBy("t").collect()] == [(0, 2), (2, 0), (4, 1)]
    m = spark.createDataFrame([("a", i, v) for i, v in enumerate([0, 0, 1, 0, 2, 2])], "k string, t long, label int")
    assert [r.median for r in timeline.median3(m, ["k"], ["t"], "label").orderBy("t").collect()] == [0, 0, 0, 1, 2, 2]
    v = spark.createDataFrame([("a", x) for x in (2, 1, 2, 1, None)], "k string, label int")
    assert timeline.majority(v, ["k"], "label").first().label == 1


def test_signal_cases(spark):
    assert one(spark, S.interp_unvoiced(floats(0, 2, 0, 4, 0)))[0] == [2, 2, 3, 4, 4] and one(spark, S.interp_unvoiced(floats(0, 0)))[0] == [0.001, 0.001]
    assert one(spark, S.normalize_peak(floats(0, 0)))[0] == [0, 0] and one(spark, S.fit_length(floats(1), 3))[0] == [1, 0, 0]
    assert one(spark, S.pick_indices(F.lit(10), 4))[0] == [0, 3, 6, 9] and one(spark, S.pitch_ratio(floats(0, 100), floats(300, 0)))[0] == 1.6
    assert one(spark, S.mono(F.array(floats(1, 3), floats(3, 5))))[0] == [2, 4] and one(spark, S.clip_to_unit(floats(2, -1)))[0] == [1, -0.5]
    assert one(spark, S.frame_energy(floats(3, 4), 5, 1))[0] == [math.sqrt(12.5)]


def test_transforms_round_trip():
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    assert np.allclose(dsp.istft(dsp.stft(x), len(x)), x, atol=1e-8)
    tone = np.sin(2 * np.pi * 200 * np.arange(8000) / 16000)
    assert abs(np.median(dsp.f0(tone)) - 200) < 5 and len(dsp.resample(tone, 16000, 8000)) == 4000
    assert np.allclose(dsp.resample(tone, 16000, 8000)[200:-200], tone[::2][200:-200], atol=0.02)
    assert dsp.log_mel(tone).shape[1] == 80 and dsp.mfcc(tone).shape[1] == 30 and dsp.lfcc(tone).shape[1] == 180
    c = dsp.dct_matrix(60, 40)
    assert np.allclose(c[40], 0, atol=1e-9) and np.allclose(c[41], -c[39], atol=1e-9)
    assert len(dsp.spectral_subtraction(tone)) == len(tone) and len(dsp.shift_pitch(tone, 16000, 1.2)) == len(tone)
    assert len(dsp.formant_speech("aə?")) > 0


def test_warping():
    a = np.array([0.0, 1, 2, 3])
    path, cost = align.dtw(a, a)
    assert cost == 0 and path == [(i, i) for i in range(4)]
    full = np.abs(a[:, None] - np.array([0.0, 0, 3])[None])
    d = np.full((5, 4), np.inf)
    d[0, 0] = 0
    for i in range(4):
        for j in range(3):
            d[i + 1, j + 1] = full[i, j] + min(d[i, j], d[i, j + 1], d[i + 1, j])
    assert align.dtw(a, np.array([0.0, 0, 3]), band=1.0)[1] == d[4, 3]
    assert align.dtw(a, np.arange(40.0), band=0.01)[1] == math.inf


def test_scorer_skips_and_search(spark):
    model = scorer.LinearScorer(np.array([[1.0, 0], [0, 1.0]]), np.zeros(2))
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [9.0, 9.0])], "id int, v array<double>")
    got = {r.id: r.scores for r in scorer.score(df, "v", model, skip=F.col("id") == 3).collect()}
    assert got[3] is None and got[1][0] > got[1][1] and got[2][1] > got[2][0]
    eps, flipped, _ = scorer.least_epsilon(np.array([0.505, 0.5]), model, 1, min_snr=0.0)
    assert scorer.least_epsilon(np.array([0.505, 0.5]), model, 1)[:2] == (0.1, True)
    assert flipped and abs(eps - 0.0025) < 1e-3
    assert scorer.least_epsilon(np.array([1.0, 0.0]), model, 1)[1] is False


def test_files_round_trip(spark, tmp_path):
    x = (0.5 * np.sin(np.arange(1600) / 10)).astype(np.float32)
    (tmp_path / "wav").mkdir()
    (tmp_path / "wav" / "a.wav").write_bytes(io.encode_wav(x, 16000))
    (tmp_path / "wav" / "b.wav").write_bytes(b"no clip")
    with wave.open(str(tmp_path / "wav" / "c.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.zeros(1600, "<i2").tobytes())
    clips = {r.clip_id.rpartition("/")[2]: r for r in io.read_wav(spark, str(tmp_path / "wav")).collect()}
    assert set(clips) == {"a.wav", "c.wav"} and np.allclose(clips["a.wav"].samples, x, atol=1e-4) and len(clips["c.wav"].samples) == 1600
    assert [r.path.rpartition("/")[2] for r in io.list_files(spark, str(tmp_path / "wav")).collect()] == ["a.wav", "b.wav", "c.wav"]
    info = {r.path.rpartition("/")[2]: r for r in io.wav_info(spark, str(tmp_path / "wav"), "a.wav").collect()}["a.wav"]
    assert info.sr == 16000 and abs(info.seconds - 0.1) < 1e-9
    (tmp_path / "m.jsonl").write_text('{"wav": "a.wav", "segments": [[0.0, 1.5, "EN"], [1.5, 2.0, "SIL"]]}\n\n')
    m = io.read_manifest(spark, str(tmp_path / "m.jsonl"))
    assert [tuple(s) for s in m.first().segments] == [(0.0, 1.5, "EN"), (1.5, 2.0, "SIL")] and m.count() == 1
    io.write_manifest(m, str(tmp_path / "m2"))
    assert io.read_manifest(spark, str(tmp_path / "m2")).collect() == m.collect()
    (tmp_path / "s.json").write_text('[[0.0, "SIL"], [0.5, "EN"]]')
    assert [(r.t_s, r.label) for r in io.read_positional(spark, str(tmp_path / "s.json"), switches=True).orderBy("seg").collect()] == [(0.0, "SIL"), (0.5, "EN")]
    d = dictionary.seed_entries(spark)
    io.write_dictionary(d, str(tmp_path / "d"))
    assert io.read_dictionary(spark, str(tmp_path / "d")).count() == d.count() == 117
    io.write_wav_table(io.read_wav(spark, str(tmp_path / "wav")), str(tmp_path / "w"), rate=16000)
    assert spark.read.parquet(str(tmp_path / "w")).count() == 2


def test_plans_prune_and_push(spark, sf_dir):
    from lexiframe.plans import registry

    plan = registry.QUERIES["topk_per_group"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "l_comment" not in plan


def test_error_rates_read_whole_turns(spark, tmp_path):
    from lexiframe.plans.registry import QUERIES

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    turns = ["one two three " * 40, "one two four " * 35 + "fünf é", "é two " * 60]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(turns)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.wer for r in QUERIES["word_error_rate"](spark, str(tmp_path)).collect()}
    assert got == {i: round(distance(turns[i - 1].split(), turns[i].split()) / len(turns[i - 1].split()), 9) for i in (1, 2)}
    got = {r.turn: r.cer for r in QUERIES["character_error_rate"](spark, str(tmp_path)).collect()}
    assert got == {i: round(distance(turns[i - 1], turns[i]) / len(turns[i - 1]), 9) for i in (1, 2)}
