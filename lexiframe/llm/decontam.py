"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of normalised benchmark items.

Each text is normalised and scanned once, as a sequence of word numbers; the offsets of its words in the original are kept, so that hits map
back to code points. A text none of whose word k-grams begins any window cannot hold one, and is passed without a scan.

The windows travel with the tasks. Benchmarks are question lists; should one have more than ``PART_WINDOWS`` windows, it is split, and the
parts are applied one after another, each with an automaton of bounded size, to the same rows without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WIDTH = 13
PART_WINDOWS = 200_000
_LEAD = 4
_BITS = 22
_SCHEMA = "doc_id long, n_words long, hits array<long>, items array<string>, spans array<long>"


class Windows:
    """Word windows of some items, as word numbers, with the items of each; the automaton is built where it is used."""

    def __init__(self, found: dict[tuple[int, ...], list[str]], vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.patterns = list(found)
        self.items = [sorted(set(found[p])) for p in self.patterns]
        self.lead = min((len(p) for p in self.patterns), default=1)
        self.lead = min(self.lead, _LEAD)
        first = np.unique(np.concatenate([C.shingles(vocabulary[np.array(p[: self.lead]) - 1], self.lead) for p in self.patterns])) if self.patterns else np.zeros(0, np.uint64)
        self.first, self._automaton = first, None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None, "_bitmap": None}

    def ready(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
            for k, p in enumerate(self.patterns):
                a.add_word(p, k)
            a.make_automaton()
            self._automaton = a
            self._bitmap = np.zeros(1 << _BITS, bool)
            self._bitmap[(self.first & C.U64((1 << _BITS) - 1)).astype(np.int64)] = True
        return self._automaton

    def may_hold(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which texts (words [first[d], first[d + 1]) of ``h``) have a k-gram that begins a window."""
        n = len(h) - self.lead + 1
        out = np.zeros(len(first) - 1, bool)
        if n <= 0:
            return out
        g = C.shingles(h, self.lead)
        at = np.flatnonzero(self._bitmap[(g & C.U64((1 << _BITS) - 1)).astype(np.int64)])
        at = at[np.isin(g[at], self.first)]
        d = np.searchsorted(first, at, "right") - 1
        out[d[(d >= 0) & (at + self.lead <= first[np.minimum(d + 1, len(first) - 1)])]] = True
        return out

    def scan(self, h: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Which words lie inside an occurrence of a window, and the items that occur."""
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        ids = np.where(self.vocabulary[at] == h, at + 1, 0)
        turn, items = np.zeros(len(h) + 1, np.int64), set()
        for end, k in self._automaton.iter(tuple(ids.tolist())):
            turn[end + 1 - len(self.patterns[k])] += 1
            turn[end + 1] -= 1
            items.update(self.items[k])
        return np.cumsum(turn[:-1]) > 0, items


def windows(items: list[tuple[object, str | None]], width: int = WIDTH) -> list[Windows]:
    """Parts of bounded size; items without id or words have no window."""
    items = [(str(i), t) for i, t in items if i is not None and t]
    if not items:
        return []
    hashes = []
    for _, _, buf, offs in C.texts(pa.array([t for _, t in items], pa.large_string())):
        w = C.Words(buf, offs, C.NOT_ALNUM)
        hashes += [w.hash[w.first[d] : w.first[d + 1]] for d in range(len(offs) - 1)]
    vocabulary = np.unique(np.concatenate(hashes))
    parts, found = [], defaultdict(list)
    for (i, _), h in zip(items, hashes):
        ids = (np.searchsorted(vocabulary, h) + 1).tolist()
        m = min(width, len(ids))
        for k in range(len(ids) - m + 1 if m else 0):
            found[tuple(ids[k : k + m])].append(i)
        if len(found) >= PART_WINDOWS:
            parts.append(Windows(found, vocabulary))
            found = defaultdict(list)
    return [*parts, Windows(found, vocabulary)] if found else parts


def runs(mask: np.ndarray) -> np.ndarray:
    """(start, end) of each run of True, end exclusive."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2)


def _scan(part: Windows | None, again: bool, keep: list[str]):
    def run(batches):
        if part:
            part.ready()
        for b in batches:
            n_words, hits, items, spans = [], [], [], []
            old = b.column("hits").to_pylist() if again else None
            had = b.column("items").to_pylist() if again else None
            for lo, hi, buf, offs in C.texts(b.column("text")):
                w = C.Words(buf, offs, C.NOT_ALNUM)
                flagged = part.may_hold(w.hash, w.first) if part else np.zeros(hi - lo, bool)
                for d in range(hi - lo):
                    s, e = w.first[d], w.first[d + 1]
                    n_words.append(int(e - s))
                    mask, found = part.scan(w.hash[s:e]) if flagged[d] else (np.zeros(e - s, bool), set())
                    if again:
                        for x, y in np.array(old[lo + d], np.int64).reshape(-1, 2):
                            mask[x:y] = True
                        found = found | set(had[lo + d])
                    r = runs(mask) if mask.any() else np.zeros((0, 2), np.int64)
                    hits.append(r.reshape(-1).astype(np.int64))
                    items.append(sorted(found))
                    if len(r):
                        point = np.concatenate([[0], np.cumsum((buf[offs[d] : offs[d + 1]] & 0xC0) != 0x80)])
                        start, end = w.start[s:e][r[:, 0]] - offs[d], w.end[s:e][r[:, 1] - 1] - offs[d]
                        spans.append(np.stack([point[start], point[end]], 1).reshape(-1).astype(np.int64))
                    else:
                        spans.append(np.zeros(0, np.int64))
            cols = {"doc_id": b.column("doc_id").cast(pa.int64()), "n_words": pa.array(n_words, pa.int64()), "hits": C.ragged(hits, pa.int64()), "items": pa.array(items, pa.list_(pa.string())), "spans": C.ragged(spans, pa.int64())}
            cols |= {c: b.column(c) for c in keep}
            yield pa.RecordBatch.from_pydict(cols)

    return run


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, hits (word runs, start and end in turn), items (sorted as strings), spans (code points in the original, likewise) and the columns named in ``keep``, a row for each row of ``docs``.

    Null texts have no words; an empty table or benchmark gives no hits. Repeated items and windows count once; items that share a window all
    occur with it. Rows that repeat an id are kept apart. Other columns are ignored."""
    parts = windows([(r[0], r[1]) for r in benchmark.select(item_col, item_text).toLocalIterator()], width)
    more = [c for c in keep if c not in ("doc_id", "text")]
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more)
    kinds = dict(out.dtypes)
    for k, part in enumerate(parts or [None]):
        last = k + 1 >= len(parts)
        carried = more + (["text"] if not last or "text" in keep else [])
        out = out.mapInArrow(_scan(part, k > 0, carried), _SCHEMA + "".join(f", {c} {kinds[c]}" for c in carried))
    return out


def _digest(items):
    return F.sha2(F.array_join(items, ","), 256)


def report(hits: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    # words of the runs: ends minus starts
    n_hit = F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda s, x: s + x)
    out = hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), _digest("items").alias("items_sha256"), *[c for c in keep if c != "doc_id"])
    return out.withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(benchmark_hits(C.read(spark, sf_dir, "documents", "doc_id", "text"), C.read(spark, sf_dir, "benchmark", "item_id", "text")))


OP7_SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 13) AS m, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM bw),
ms AS (SELECT DISTINCT m FROM bs),
dp AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d JOIN ms ON len(w) >= m),
ds AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s FROM dp),
h AS (SELECT ds.doc_id, ds.i, ds.m, bs.item_id FROM ds JOIN bs ON bs.m = ds.m AND bs.s = ds.s),
hw AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hw.n, 0)::BIGINT AS n_hit, coalesce(hi.n, 0)::BIGINT AS n_items,
  sha256(coalesce(hi.s, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AND 20 * coalesce(hw.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hw ON hw.doc_id = d.doc_id LEFT JOIN hi ON hi.doc_id = d.doc_id
"""
