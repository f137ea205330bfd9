"""What the operators share: staged tables, table readers, and vectorised hashing of words over Arrow buffers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Bytes of text that are hashed at a time: bounds a worker's memory (about 60 bytes of scratch per byte) and keeps the scratch in the processor's cache.
CHUNK_BYTES = 1 << 17

_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of words that are runs without ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of words that are runs of digits, letters and everything beyond ASCII.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[48:58] = False
NOT_ALNUM[97:123] = False


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    """A table of the given folder, by Spark's reader alone."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*cols)


_own: dict[str, str] = {}


def stage_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only where it is unset (tests) a folder of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own["dir"] = tempfile.mkdtemp(prefix="lexiframe-")
        where = _own["dir"]
    return where.rstrip("/")


class Stage:
    """Tables written to the shared folder to cut lineage; ``drop`` removes one that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lexiframe_path = path
        return out

    def tidy(self) -> None:
        """Lets the driver's cleaner see that finished steps need their shuffle files no more; else these stay until the driver happens to collect its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_lexiframe_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (variant 13 of the public splitmix family)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_pw = np.ones(1, np.uint64)
_ipw = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pw, _ipw
    if len(_pw) < n:
        size = max(n, 2 * len(_pw), CHUNK_BYTES)
        _pw = np.concatenate([[U64(1)], np.cumprod(np.full(size - 1, _BASE, np.uint64))])
        _ipw = np.concatenate([[U64(1)], np.cumprod(np.full(size - 1, _BASE_INV, np.uint64))])
    return _pw, _ipw


class Words:
    """Words of some texts: ``hash``, byte ``start`` and ``end``; those of text d are [first[d], first[d + 1])."""

    __slots__ = ("hash", "start", "end", "first", "_total", "_ipw")

    def __init__(self, buf: np.ndarray, offs: np.ndarray, sep: np.ndarray):
        n = len(buf)
        inside = ~sep[buf]
        head = np.zeros(n + 1, bool)
        head[offs] = True
        head[n] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | head[:n]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | head[1:])) + 1
        pw, ipw = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODE[buf] * pw[:n], out=total[1:])
        self._total, self._ipw = total, ipw
        self.hash = self._of(self.end)
        self.first = np.searchsorted(self.start, offs)

    def _of(self, end: np.ndarray) -> np.ndarray:
        h = (self._total[end] - self._total[self.start]) * self._ipw[self.start]
        return mix(h + (end - self.start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))

    def prefix(self, k: int) -> np.ndarray:
        """Hashes of the first k bytes of each word, or of the whole of a shorter one."""
        return self._of(np.minimum(self.end, self.start + k))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words; of fewer words, one hash of all of them; of none, nothing."""
    if not len(h):
        return h
    m = min(n, len(h))
    out = np.full(len(h) - m + 1, m, np.uint64)
    for k in range(m):
        out = mix(out * U64(0x9FB21C651E98DF25) + h[k : len(h) - m + 1 + k])
    return out


def texts(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in them) of at most CHUNK_BYTES each, or of one longer row.

    Null counts as empty. Texts are cut nowhere."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK_BYTES, "right")) - 1)
        hi = min(hi, len(column))
        buf = data[offs[lo] : offs[hi]]
        yield lo, hi, LOWER[buf] if lower else buf, offs[lo : hi + 1] - offs[lo]
        lo = hi


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64) if h.dtype == np.uint64 else h.astype(np.int64)


def ragged(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column without Python objects."""
    offs = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offs[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat, kind))


#: Ids (8 bytes each) and small rows that are broadcast at most; larger tables are joined by shuffle.
SMALL_IDS = 500_000


def only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is among ``ids`` (written already), without dealing out the rows if the ids are few enough to be broadcast."""
    from pyspark.sql import functions as F

    ids = ids.select(key)
    return rows.join(F.broadcast(ids) if ids.count() <= SMALL_IDS else ids, key, "left_semi")


def row_keys(spark: SparkSession, rows: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``rows`` with ``row``, and whether all have an id of their own: the id where it is one row's alone, else (null, negative or repeated) a hash of id and text with the sign set, so that
    such rows alone could ever be taken for each other. Equal rows have one key."""
    from pyspark.sql import functions as F

    key = F.col(id_col).cast("long")
    again = Stage(spark, "ids").table(rows.groupBy(key.alias("_id")).count().where("count > 1 OR _id IS NULL OR _id < 0").select("_id"))
    n = again.count()
    odd = F.xxhash64(text_col, id_col).bitwiseOR(F.lit(-(1 << 63)))
    if not n:
        return rows.withColumn("row", key), True
    again = again.where("_id IS NOT NULL").withColumn("_odd", F.lit(True))
    marked = rows.withColumn("_id", key).join(F.broadcast(again) if n <= SMALL_IDS else again, "_id", "left")
    return marked.withColumn("row", F.when(F.col("_odd") | F.col("_id").isNull(), odd).otherwise(F.col("_id"))).drop("_id", "_odd"), False


def labelled_sample(spark: SparkSession, labels: DataFrame, label: str, held_out: tuple[int, int], most: int, seed: int = 11) -> DataFrame:
    """(doc_id, y) of at most ``most`` labelled rows, least hash first; ``held_out`` (m, r): ids whose crc32 mod m is r stay out.

    Rows without id or label are left out; of an id with several labels the largest counts."""
    from pyspark.sql import functions as F

    m, r = held_out
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string")) % m != r).groupBy("doc_id").agg(F.max("y").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)


def held_out_flag(m: int, r: int):
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % m == r, F.lit(False))
