"""Removal of long substrings that occur more than once, by external suffix sorting of shards.

Every window of ``window`` bytes has a key, the least hash among its 32-byte strings; equal windows have equal keys. A text falls into segments,
maximal runs of windows of one key (185 windows on average, for 400 bytes). (1) One pass lists the segments of all texts, without their bytes. (2) Keys
that occur once are dropped; that is most of the corpus. (3) Segments of equal bytes are counted by digest: those that occur twice repeat as a
whole. (4) One representative of each different segment whose key is shared goes, with its bytes, to the shard of its key. There all suffixes
are sorted with their common prefixes (suffix_sort, from scratch files where a shard is larger than memory); neighbours that share a window's length mark the windows that repeat.
(5) Bytes covered by repeated windows are removed.

Copies therefore meet as digests, pre-aggregated before they are dealt out; what a shard sorts are different texts only.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .suffix_sort import suffixes

WINDOW, GRAM = 400, 32
SHARD_BYTES = 4 << 20
MEMORY = 64 << 20


def _gram_hash(buf: np.ndarray) -> np.ndarray:
    """Hashes of all 32-byte strings, by doubling."""
    h, n = C.BYTE_CODE[buf], 1
    while n < GRAM:
        h = h[:-n] * C.U64(2 * (0x9E3779B97F4A7C15 >> n) + 1) + (h[n:] ^ (h[n:] >> C.U64(31)))
        n *= 2
    return C.mix(h)


def _sliding(h: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over each ``width`` consecutive values, by doubling."""
    n = 1
    while 2 * n <= width:
        h = pick(h[:-n], h[n:])
        n *= 2
    return pick(h[: len(h) - (width - n)], h[width - n :]) if n < width else h


def segments(buf: np.ndarray, offs: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, key, whether the key's string occurs twice in it) of each segment; positions are bytes in ``buf``."""
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64), np.zeros(0, bool))
    n, width = len(buf), window - GRAM + 1
    if n < window:
        return none
    h = _gram_hash(buf)
    least = _sliding(h, width, np.minimum)
    text = np.searchsorted(offs, np.arange(len(least)), "right") - 1
    inside = np.arange(len(least)) + window <= offs[text + 1]
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    start = np.flatnonzero(change & inside)
    if not len(start):
        return none
    stop = np.ones(len(least), bool)
    stop[:-1] = change[1:] | ~inside[1:]
    end = np.flatnonzero(stop & inside)
    key = least[start]
    # a string is chosen if it is the least of some window; the window's least is never above any of its strings
    covered = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), np.where(inside, least, C.U64(0)), np.zeros(width - 1, np.uint64)]), width, np.maximum)
    chosen = np.flatnonzero(covered[: len(h)] == h)
    lo, hi = np.searchsorted(chosen, start), np.searchsorted(chosen, end + width)
    of = np.repeat(np.arange(len(start)), hi - lo)
    at = chosen[np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
    twice = np.bincount(of[h[at] == key[of]], minlength=len(start)) > 1
    return text[start], start, end, key, twice


def _list(window: int):
    def run(batches):
        for b in batches:
            rows = b.column(0).to_numpy()
            for lo, _, buf, offs in C.texts(b.column(1), lower=False):
                text, start, end, key, twice = segments(buf, offs, window)
                raw = memoryview(np.ascontiguousarray(buf))
                digest = np.frombuffer(b"".join(hashlib.blake2b(raw[s : e + window], digest_size=8).digest() for s, e in zip(start.tolist(), end.tolist())), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(digest), pa.array(rows[lo + text]), pa.array(start - offs[text]), pa.array(end - offs[text] + window), pa.array(twice)], ["key", "digest", "row", "s", "e", "twice"])

    return run


def _cut(batches):
    """The bytes of the wanted segments of each text."""
    for b in batches:
        wanted = b.column("wanted").to_pylist()
        for lo, hi, buf, offs in C.texts(b.column("text"), lower=False):
            raw = buf.tobytes()
            rows = [(b.column("row")[d].as_py(), w, raw[offs[d - lo] + w["s"] : offs[d - lo] + w["e"]]) for d in range(lo, hi) for w in wanted[d]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([w["key"] for _, w, _ in rows], pa.int64()), pa.array([r for r, _, _ in rows], pa.int64()), pa.array([w["s"] for _, w, _ in rows], pa.int64()), pa.array([w["n"] for _, w, _ in rows], pa.int64()), pa.array([x for _, _, x in rows], pa.binary())], ["key", "row", "s", "n", "bytes"])


def repeated(parts: list[bytes], window: int, memory: int = MEMORY) -> list[np.ndarray]:
    """For each part the starts of its windows that occur anywhere else among all parts."""
    offs = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
    with tempfile.TemporaryFile(prefix="shard-") as f:
        for p in parts:
            f.write((np.append(np.frombuffer(p, np.uint8).astype(np.uint16) + 1, 0)).astype(np.uint16).tobytes())
        f.flush()
        t = np.memmap(f, np.uint16, "r", shape=(int(offs[-1]),)) if offs[-1] * 2 > memory else np.frombuffer(_back(f), np.uint16)
        return _marks(t, offs, window, memory)


def _back(f) -> bytes:
    f.seek(0)
    return f.read()


def _marks(t: np.ndarray, offs: np.ndarray, window: int, memory: int) -> list[np.ndarray]:
    mark = np.zeros(len(t), bool)
    last = None
    for at, lcp in suffixes(t, 257, window, memory):
        hit = lcp >= window
        mark[at[hit]] = True
        mark[at[:-1][hit[1:]]] = True
        if hit[0] and last is not None:
            mark[last] = True
        last = at[-1]
    found = np.flatnonzero(mark)
    # a common prefix that runs over a part's end is no window
    part = np.searchsorted(offs, found, "right") - 1
    ok = found + window < offs[part + 1]
    found, part = found[ok], part[ok]
    first = np.searchsorted(part, np.arange(len(offs)))
    return [found[first[k] : first[k + 1]] - offs[k] for k in range(len(offs) - 1)]


def _sort(window: int):
    def run(batches):
        parts, row, s, n = [], [], [], []
        for b in batches:
            parts += b.column("bytes").to_pylist()
            row += b.column("row").to_pylist()
            s += b.column("s").to_pylist()
            n += b.column("n").to_pylist()
        if not parts:
            return
        out_row, out_s, out_e = [], [], []
        for k, at in enumerate(repeated(parts, window)):
            if n[k] == 1 and len(at):
                cut = np.flatnonzero(np.diff(at) > window) + 1
                for g in np.split(at, cut):
                    out_row.append(row[k])
                    out_s.append(s[k] + int(g[0]))
                    out_e.append(s[k] + int(g[-1]) + window)
        # windows that lie less than a window apart leave no byte between them
        yield pa.RecordBatch.from_arrays([pa.array(out_row, pa.int64()), pa.array(out_s, pa.int64()), pa.array(out_e, pa.int64())], ["row", "s", "e"])

    return run


def _strip(batches):
    for b in batches:
        spans = b.column("spans").to_pylist()
        ids, total, gone, runs, sha, out = [], [], [], [], [], []
        for lo, hi, buf, offs in C.texts(b.column("text"), lower=False):
            raw = buf.tobytes()
            for d in range(lo, hi):
                t, at, kept, merged = raw[offs[d - lo] : offs[d - lo + 1]], 0, [], []
                for x in zip((spans[d] or ())[::2], (spans[d] or ())[1::2]):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
                for s, e in merged:
                    kept.append(t[at:s])
                    at = e
                kept.append(t[at:])
                kept = b"".join(kept)
                total.append(len(t))
                gone.append(len(t) - len(kept))
                runs.append(len(merged))
                sha.append(hashlib.sha256(kept).hexdigest())
                out.append([v for m in merged for v in m])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def repeated_substrings(spark: SparkSession, docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed: start and end bytes in turn), a row for each row of ``docs``.

    A byte goes if a string of ``window`` bytes that covers it also starts elsewhere, in any text or the same one. Null counts as empty; shorter texts lose nothing.
    Rows that repeat an id are texts of their own, equal rows copies of each other. An empty table gives an empty one; other columns are ignored."""
    stage = C.Stage(spark, "substrings")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, alone = C.row_keys(spark, rows, "doc_id", "text")
    once = rows if alone else rows.where("row >= 0").unionByName(rows.where("row < 0").dropDuplicates(["row"]))  # equal rows are cut once
    every = stage.table(rows.where(F.octet_length("text") >= window).select("row", "text").mapInArrow(_list(window), "key long, digest long, row long, s long, e long, twice boolean"))
    shared = every.groupBy("key").agg(F.count("*").alias("k"), F.max("twice").alias("t")).where("k > 1 OR t").select("key")
    some = stage.table(every.join(shared, "key"))
    stage.drop(every)
    kinds = stage.table(some.groupBy("key", "digest").agg(F.count("*").alias("n"), F.min(F.struct("row", "s", "e")).alias("x"), F.max("twice").alias("t")))
    whole = some.join(kinds.where("n > 1").select("key", "digest"), ["key", "digest"]).select("row", "s", "e")
    mixed = kinds.groupBy("key").agg(F.count("*").alias("k"), F.max("t").alias("t"), F.min("n").alias("least")).where("least = 1 AND (k > 1 OR t)").select("key")
    wanted = stage.table(kinds.join(mixed, "key").select("key", F.col("x.row").alias("row"), F.col("x.s").alias("s"), F.col("x.e").alias("e"), "n"))
    size, n = wanted.agg(F.coalesce(F.sum(F.col("e") - F.col("s")), F.lit(0)), F.count("*")).first()
    found = whole
    if size:
        lists = wanted.groupBy("row").agg(F.collect_list(F.struct("key", "s", "e", "n")).alias("wanted"))
        # few lists go to the texts; many are met by shuffle
        texts = once.join(F.broadcast(lists), "row") if n <= C.SMALL_IDS else C.only(once, stage.table(wanted.select("row").distinct()), "row").join(lists, "row")
        cut = texts.select("row", "text", "wanted").mapInArrow(_cut, "key long, row long, s long, n long, bytes binary")
        shards = max(1, -(-size // SHARD_BYTES))
        found = found.unionByName(stage.table(cut.repartition(shards, "key").mapInArrow(_sort(window), "row long, s long, e long")))
    spans = found.groupBy("row").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("s", "e")))).alias("xs"))
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    grown = lambda acc, x: F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), F.array(F.greatest(last(acc), x["e"])))
    merged = F.aggregate("xs", F.array().cast("array<long>"), lambda acc, x: F.when((F.size(acc) > 0) & (last(acc) >= x["s"]), grown(acc, x)).otherwise(F.concat(acc, F.array(x["s"], x["e"]))))
    spans = stage.table(spans.select("row", merged.alias("spans")))
    # few spans, merged, go to the texts; many are met by shuffle
    if spans.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0] <= 2 * C.SMALL_IDS:
        spans = F.broadcast(spans)
    return rows.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(_strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_substrings(spark, C.read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
