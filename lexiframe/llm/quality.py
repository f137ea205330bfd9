"""Quality classifier: supervised subword embeddings.

Words, pairs of words and character n-grams are hashed to buckets; each bucket has a learned vector, a document is the average of its
features' vectors, and a softmax over two classes reads it. Vectors and output weights are trained by stochastic gradient descent in numpy on a
bounded sample of labelled rows (``SAMPLE``); their features are hashed on the executors, where a row has at most ``BUCKETS`` of them.

The output is linear in the average, so that for scoring each bucket needs only its product with the difference of the output weights:
one number a bucket, a table of 512 KB that travels with the tasks. Every text is scored whole, in one pass, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SAMPLE, BUCKETS, DIM, EPOCHS, RATE = 6000, 1 << 17, 8, 5, 0.5
GRAMS = (3, 4)
HELD_OUT = (5, 0)
THRESHOLD = 0.3
_MASK = C.U64(BUCKETS - 1)


def _features(buf: np.ndarray, offs: np.ndarray):
    """(buckets, limits) for each family of features; those of text d are [limits[d], limits[d + 1])."""
    w = C.Words(buf, offs, C.SPACE)
    yield (w.hash & _MASK).astype(np.int64), w.first
    h = w.hash
    if len(h) > 1:  # pairs, and whether a word repeats the one before it
        repeat = h[1:] == h[:-1]
        pair = np.where(repeat, C.U64(0x51ED270B0A1F39C1), C.mix(h[:-1] * C.U64(3) + h[1:]))
        inner = np.ones(len(pair), bool)
        cut = w.first[1:-1]
        inner[cut[(cut > 0) & (cut <= len(pair))] - 1] = False
        at = np.flatnonzero(inner)
        yield (pair[at] & _MASK).astype(np.int64), np.searchsorted(at, w.first)
    code = C.BYTE_CODE[buf]
    for n in GRAMS:
        m = len(buf) - n + 1
        if m <= 0:
            continue
        g = code[:m].copy()
        for k in range(1, n):
            g = g * C.U64(0x9E3779B97F4A7C15) + code[k : m + k]
        g ^= g >> C.U64(29)
        inner = np.ones(m, bool)
        for k in range(1, n):
            cut = offs[1:-1] - k
            inner[cut[(cut >= 0) & (cut < m)]] = False
        at = np.flatnonzero(inner)
        yield (((g[at] * C.U64(0xBF58476D1CE4E5B9)) >> C.U64(40)) & _MASK).astype(np.int64), np.searchsorted(at, offs)


def _bags(batches):
    for b in batches:
        idx, cnt = [], []
        for lo, hi, buf, offs in C.texts(b.column(2), lower=False):
            parts = list(_features(buf, offs))
            for d in range(hi - lo):
                i, n = np.unique(np.concatenate([f[at[d] : at[d + 1]] for f, at in parts]), return_counts=True)
                idx.append(i.astype(np.int32))
                cnt.append(n.astype(np.float32))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), C.ragged(idx, pa.int32()), C.ragged(cnt, pa.float32())], ["doc_id", "y", "idx", "cnt"])


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 3) -> tuple[np.ndarray, float]:
    """(number of each bucket, bias) from (label, buckets, counts) rows; without rows of both classes, the smoothed share of ones alone."""
    y = np.array([b[0] for b in bags])
    one = float((y == 1).sum())
    prior = float(np.log((one + 0.5) / (len(y) - one + 0.5)))
    if one in (0, len(y)):
        return np.zeros(BUCKETS, np.float32), prior
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = rng.uniform(-0.5, 0.5, (2, DIM)).astype(np.float32)
    bias = np.array([0.0, prior], np.float32)
    seen = np.zeros(BUCKETS, np.float32)
    share = [(i, (c / max(1.0, float(c.sum()))).astype(np.float32)) for _, i, c in bags]
    for epoch in range(EPOCHS):
        rate = np.float32(RATE * (1 - epoch / EPOCHS))
        for k in rng.permutation(len(bags)):
            i, c = share[k]
            if not len(i):
                continue
            e = emb[i]
            h = c @ e
            z = out @ h + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            g = -p
            g[y[k]] += 1
            back = g @ out
            out += np.float32(0.1) * rate * np.outer(g, h)
            bias += np.float32(0.02) * rate * g
            # steps adapted to each bucket's past gradients, as shares of rare and of common features differ by orders of magnitude
            seen[i] += (c * c) * np.float32(back @ back)
            emb[i] = e + rate * (c / np.sqrt(seen[i] + np.float32(1e-12)))[:, None] * back[None, :]
    return emb @ (out[1] - out[0]), float(bias[1] - bias[0])


def _score(table: np.ndarray, bias: float):
    def run(batches):
        for b in batches:
            out = []
            for lo, hi, buf, offs in C.texts(b.column(1), lower=False):
                total, n = np.zeros(hi - lo), np.zeros(hi - lo)
                for f, at in _features(buf, offs):
                    s = np.concatenate([[0.0], np.cumsum(table[f], dtype=np.float64)])
                    total += s[at[1:]] - s[at[:-1]]
                    n += at[1:] - at[:-1]
                out.append(1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -30, 30))))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    return run


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: tuple[int, int] = HELD_OUT, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``.

    Null and empty texts have no features and score as the bias says. Repeated ids are scored apart, in training each counts. A null id is not
    held out and has no label. Without labels of both classes every text scores their smoothed share. Columns other than doc_id and text are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = C.labelled_sample(spark, labels, label, held_out, sample)
    bags = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(_bags, "doc_id long, y int, idx array<int>, cnt array<float>")
    got = sorted(((r.doc_id, r.y, np.array(r.idx, np.int32), np.array(r.cnt, np.float32)) for r in _rows(bags)), key=lambda r: (r[0], len(r[2])))
    table, bias = train([r[1:] for r in got])
    scored = rows.mapInArrow(_score(table, bias), "doc_id long, score double")
    return scored.select("doc_id", C.held_out_flag(*held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


class _Row:
    __slots__ = ("doc_id", "y", "idx", "cnt")

    def __init__(self, *x):
        self.doc_id, self.y, self.idx, self.cnt = x


def _rows(bags: DataFrame):
    """The bounded sample, column-wise, without Python objects for its numbers."""
    t = bags.toArrow().combine_chunks()
    for c in t.to_batches():
        idx, cnt = c.column("idx"), c.column("cnt")
        for k in range(c.num_rows):
            yield _Row(c.column("doc_id")[k].as_py(), c.column("y")[k].as_py(), idx[k].values.to_numpy(), cnt[k].values.to_numpy())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, C.read(spark, sf_dir, "documents", "doc_id", "text"), C.read(spark, sf_dir, "labels", "doc_id", "quality"))
