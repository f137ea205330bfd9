"""Operators that no registered query reaches in full."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiframe.functions import signal as S
from lexiframe.functions import text as X
from lexiframe.operators import dictionary, dsp, lm, metrics
from lexiframe.sources import io


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def test_edit_distance_of_tokens(spark):
    r = random.Random(1)
    pairs = [([f"w{r.randrange(n)}" for _ in range(r.randint(0, 40))], [f"w{r.randrange(n)}" for _ in range(r.randint(0, 40))]) for n in (2, 5, 30, 1000) for _ in range(10)]
    many = [f"v{i}" for i in range(1500)]
    pairs += [([], []), (["é"], []), (many, many[::-1]), (many, many[3:] + ["x"])]
    got = spark.createDataFrame(pairs, "a array<string>, b array<string>").select(metrics.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [x.d for x in got] == [_edits(a, b) for a, b in pairs]


def test_translation_by_map_and_by_join_agree(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "The cat, of  mine!"), (2, ""), (3, None), (4, "none here")], "id int, text string")
    entries = spark.createDataFrame([("the", "DET"), ("of", "PREP"), ("cat", "CAT"), ("cat", "DOG")], "key string, ol string")
    by_map = {r.id: r.translation for r in dictionary.translate(texts, entries, ["id"]).collect()}
    monkeypatch.setattr(dictionary, "SMALL", 2)
    assert by_map == {r.id: r.translation for r in dictionary.translate(texts, entries, ["id"]).collect()}
    assert by_map == {1: "DET CAT PREP mine!", 2: "", 3: "", 4: "none here"}
    monkeypatch.setattr(dictionary, "SMALL", 1000)
    assert dictionary.translate(texts, entries.where("false"), ["id"]).where("id = 1").first().translation == "The cat, of mine!"


def test_numbered_words_are_in_order(spark):
    words = sorted({"".join(random.Random(i).choices("abc", k=1 + i % 5)) for i in range(200)} | {"é", "z"})
    got = {r.w: r.id for r in lm.numbered(spark.createDataFrame([(w,) for w in words], "w string")).collect()}
    assert got == {w: i for i, w in enumerate(words, 1)}


def test_warped_clips_keep_the_targets_length(spark):
    t = np.arange(8000) / 8000
    rows = [(1, (0.5 * np.sin(2 * np.pi * 120 * t)).tolist(), (0.2 * np.sin(2 * np.pi * 180 * t)).tolist())]
    got = dsp.warp_waveform(spark.createDataFrame(rows, "id int, s array<double>, t array<double>"), "s", 8000, "t", 8000).first()
    y = np.array(got.warped)
    assert set(got.asDict()) == {"id", "s", "t", "warped"} and len(y) == 8000
    assert np.abs(y[2000:6000]).max() > 1.5 * 0.2  # the source is louder


def test_wav_files_and_regrids(spark, tmp_path):
    clips = spark.createDataFrame([("a", [0.5, -0.5]), ("b", []), ("c", None)], "clip_id string, samples array<double>")
    assert io.write_wav(clips, str(tmp_path), rate=8000) == 3
    (tmp_path / "broken.wav").write_bytes(b"RIFF")
    back = {r.clip_id.rpartition("/")[2]: list(r.samples) for r in io.read_wav(spark, str(tmp_path), rate=None).collect()}
    assert back == {"a.wav": [0.5, -0.5], "b.wav": [], "c.wav": []} or np.allclose(back["a.wav"], [0.5, -0.5], atol=1e-4)
    one = spark.range(1).select(S.regrid(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), 5).alias("up"), S.regrid(F.array().cast("array<double>"), 2).alias("none"), X.preview(F.lit("aé€"), 3).alias("shown")).first()
    assert one.up == [1.0, 1.0, 2.0, 2.0, 3.0] and one.none == [0.0, 0.0] and one.shown == "a\\xe9\\u20ac"


def test_reports_note_what_languages_need(spark):
    df = spark.createDataFrame([("a b", "a c", ["EN", "HI"]), ("a b", "a b", ["EN"])], "r string, h string, l array<string>")
    both, one = [x[0] for x in df.select(metrics.error_report(F.col("r"), F.col("h"), X.split_words, F.col("l"))).collect()]
    assert '"WER_overall":0.5' in both and '"WER_en_segments":null' in both and "note" in both and one == '{"WER_overall":0.0,"CER_overall":0.0}'


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        io.scratch_dir(Session())
