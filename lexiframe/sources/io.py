"""Sources and sinks: WAV clips, manifests, positional JSON, dictionaries, texts, model tables. All by Spark's readers and writers."""

from __future__ import annotations

import io
import struct
import tempfile
import uuid
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = "array<struct<start_s:double,end_s:double,label:string>>"


def decode_wav(data: bytes, mono: bool = True) -> tuple[int, np.ndarray]:
    with wave.open(io.BytesIO(data)) as w:
        kind = {1: np.uint8, 2: np.int16, 4: np.int32}[w.getsampwidth()]
        x = np.frombuffer(w.readframes(w.getnframes()), kind).astype(np.float64)
        x = (x - 128) / 128 if kind is np.uint8 else x / float(2 ** (8 * w.getsampwidth() - 1))
        x = x.reshape(-1, w.getnchannels())
        return w.getframerate(), (x.mean(1) if mono else x.reshape(-1)).astype(np.float32)


def encode_wav(samples: np.ndarray, rate: int = 22050) -> bytes:
    """16-bit; divided by the peak only where that is over 1."""
    x = np.asarray(samples, np.float64)
    x = x / max(1.0, float(np.abs(x).max()) if len(x) else 1.0)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.round(x * 32767).astype("<i2").tobytes())
    return out.getvalue()


def _decode(rate: int | None):
    def run(batches: Iterator[pa.RecordBatch]):
        from ..operators.dsp import resample

        for b in batches:
            paths, rates, samples = [], [], []
            for p, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    sr, x = decode_wav(data)
                except (wave.Error, EOFError, KeyError, ValueError, struct.error):
                    continue  # a file that is no clip gives no row
                if rate and sr != rate:
                    sr, x = rate, resample(x, sr, rate).astype(np.float32)
                paths.append(p)
                rates.append(sr)
                samples.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(rates, pa.int32()), pa.array(samples, pa.list_(pa.float32()))], ["clip_id", "sr", "samples"])

    return run


def read_wav(spark: SparkSession, path: str, rate: int | None = 16000, pattern: str = "*.wav") -> DataFrame:
    """(clip_id, sr, samples): mono clips, brought to one rate if given; files that do not decode are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_decode(rate), "clip_id string, sr int, samples array<float>")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) in lexicographic order; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length").orderBy("path")


def wav_info(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """(path, sr, seconds) from the header of plain 16-byte-format files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    def number(at: int, n: int):
        parts = [F.conv(F.hex(F.substring("content", at + k, 1)), 16, 10).cast("long") * F.lit(256**k) for k in range(n)]
        return sum(parts[1:], parts[0])

    return files.select("path", number(25, 4).cast("int").alias("sr"), ((F.col("length") - 44) / number(29, 4)).alias("seconds"))


def explode_samples(clips: DataFrame) -> DataFrame:
    """(clip_id, i, v); written as Parquet, a range of samples is a filter on ``i`` that reaches the scan."""
    return clips.select("clip_id", F.posexplode("samples").alias("i", "v"))


def write_wav_table(clips: DataFrame, path: str, samples: str = "samples", rate: int = 22050) -> None:
    """One row a clip, (clip_id, wav: bytes of a WAV file), as Parquet in any store that Spark writes."""
    encode = F.udf(lambda x: encode_wav(np.asarray(x, np.float64), rate), "binary", useArrow=True)
    clips.select("clip_id", encode(F.col(samples)).alias("wav")).write.mode("overwrite").parquet(path)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; one of our own only where it is unset and all runs on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lexiframe-")
    return f"{where.rstrip('/')}/{uuid.uuid4().hex[:12]}"


def write_wav(clips: DataFrame, path: str, samples: str = "samples", rate: int = 22050) -> int:
    """One WAV file a clip, <clip_id>.wav under ``path`` in any store that Arrow writes; returns how many. A task that is tried again writes the same files again."""

    def run(batches: Iterator[pa.RecordBatch]):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        store.create_dir(root, recursive=True)
        for b in batches:
            for name, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with store.open_output_stream(f"{root}/{name}.wav") as f:
                    f.write(encode_wav(np.asarray(x or [], np.float64), rate))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    done = clips.select(F.col("clip_id").cast("string"), F.col(samples)).mapInArrow(run, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def decode_clips(df: DataFrame, rate: int | None = 16000, path_bytes: str = "content", inline: str = "wav", key: str = "clip_id") -> DataFrame:
    """(clip_id, sr, samples) of rows that carry a clip under a path, or else with the row; rows that do not decode are left out."""
    rows = df.select(F.col(key).cast("string").alias("path"), prefer_path_bytes(F.col(path_bytes), F.col(inline)).alias("content")).where("content IS NOT NULL")
    return rows.mapInArrow(_decode(rate), "clip_id string, sr int, samples array<float>")


def positional_segments(column):
    """``[[0.0, 8.0, "EN"], ...]`` as structs."""
    rows = F.from_json(column, "array<array<string>>")
    return F.transform(rows, lambda r: F.struct(r[0].cast("double").alias("start_s"), r[1].cast("double").alias("end_s"), r[2].alias("label")))


def positional_switches(column):
    rows = F.from_json(column, "array<array<string>>")
    return F.transform(rows, lambda r: F.struct(r[0].cast("double").alias("t_s"), r[1].alias("label")))


def read_positional(spark: SparkSession, path: str, switches: bool = False) -> DataFrame:
    """(path, rows...) of files that hold one positional array each."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    rows = positional_switches(F.col("value")) if switches else positional_segments(F.col("value"))
    return whole.select("path", F.posexplode(rows).alias("seg", "x")).select("path", "seg", "x.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(wav, segments) of JSON lines; blank lines are passed over."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    outer = F.from_json("value", "struct<wav:string,segments:string>")
    return lines.select(outer.alias("x")).select("x.wav", positional_segments(F.col("x.segments")).alias("segments"))


def write_manifest(df: DataFrame, path: str) -> None:
    """JSON lines with positional segments."""
    rows = F.transform("segments", lambda s: F.concat(F.lit("["), s["start_s"].cast("string"), F.lit(","), s["end_s"].cast("string"), F.lit(',"'), s["label"], F.lit('"]')))
    line = F.concat(F.lit('{"wav":'), F.to_json(F.struct("wav")).substr(F.lit(8), F.length(F.to_json(F.struct("wav"))) - 8), F.lit(',"segments":['), F.array_join(rows, ","), F.lit("]}"))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(key, ol, deva, hi, gloss) of a JSON object of entries."""
    entry = "struct<ol:string,deva:string,hi:string,gloss:string>"
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("key", "e")).select("key", "e.*")


def write_dictionary(entries: DataFrame, path: str) -> None:
    """One JSON object, as the reader above takes it; dictionaries have hundreds of entries."""
    pairs = F.map_from_entries(F.collect_list(F.struct("key", F.struct("ol", "deva", "hi", "gloss"))))
    entries.agg(F.to_json(pairs).alias("value")).write.mode("overwrite").text(path)


def prefer_path_bytes(path_bytes, inline):
    """Bytes found under the path if there are any, else those that came with the row."""
    return F.coalesce(path_bytes, inline)


def save_model(model, path: str) -> None:
    """A language model as tables; no pickles."""
    for name in ("ngram", "context", "cont", "meta"):
        getattr(model, name).write.mode("overwrite").parquet(f"{path}/{name}")
    model.ngram.sparkSession.range(1).select(F.lit(model.denominator).cast("long").alias("denominator")).write.mode("overwrite").parquet(f"{path}/total")


def load_model(spark: SparkSession, path: str):
    from ..operators.lm import Model

    parts = [spark.read.parquet(f"{path}/{name}") for name in ("ngram", "context", "cont", "meta")]
    return Model(*parts, spark.read.parquet(f"{path}/total").first().denominator)
