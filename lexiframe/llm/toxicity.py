"""Toxicity by a noisy channel: words hidden by leetspeak, spacing and repetition are restored, then the restored text is scored.

(1) A character trigram model is counted over all texts, whole, in one pass with partial sums (28^3 counters a task). (2) Suspicious strings
are found by rules: words that mix letters with look-alike digits or signs, letters three times or more in a row, and single letters
strung out by blanks or points. (3) Each gives a lattice: what letter each sign may stand for, a run kept once or twice, separators dropped. Viterbi
decoding under the character model picks the reading. (4) Features of a word are itself and its first four and five bytes, hashed. Their document frequencies among
toxic and other documents of a bounded labelled sample (``SAMPLE``) give each a lower confidence bound of its log odds; a text scores as its strongest
feature, original or restored, by a logistic curve fitted on the part of the sample that the counts left out.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SAMPLE, BUCKETS = 20_000, 1 << 20
HELD_OUT = (3, 1)
THRESHOLD = 0.7
#: A feature needs so many toxic documents, and so strong a bound, to count.
MIN_DOCS, MIN_WEIGHT = 4, 0.5
PREFIXES, STRONGEST = (4, 5, 6, 7, 8), 2
#: Longer strings, repeats collapsed, are several words and read with blanks.
MAX_HIDDEN = 32
_MASK = C.U64(BUCKETS - 1)

SYMBOLS = 28
_CHAR = np.zeros(256, np.int64)
_CHAR[97:123] = np.arange(1, 27)
_CHAR[65:91] = np.arange(1, 27)
_CHAR[128:] = 27

#: Look-alikes and the letters that each may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SUBSTITUTE, REPEAT, KEEP_TWO = -1.5, -0.2, -1.0
_TRIM = " .,;:?\"')]}>»…"
_SPACED = re.compile(r"(?<![^\s.,;:?!\"'(])((?:[A-Za-z0-9@$!|+][ .\-_*]{1,2}){2,}[A-Za-z0-9@$!|+])(?![^\s.,;:?!\"')])")
_REPEATED = re.compile(r"([a-z])\1\1")

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True
_LOOKALIKE = np.zeros(256, bool)
_LOOKALIKE[[ord(c) for c in LEET if ord(c) < 128]] = True
_JOINT = np.zeros(256, bool)
_JOINT[[ord(c) for c in ".-_*"]] = True


# ---- the character model


def _count(batches):
    total = np.zeros(SYMBOLS**3, np.int64)
    for b in batches:
        for _, _, buf, offs in C.texts(b.column(0), lower=False):
            c = _CHAR[buf]
            # a text begins and ends with the blank symbol; sequences never cross texts
            c = np.insert(c, np.repeat(offs[1:-1], 2), 0)
            c = np.concatenate([[0, 0], c, [0, 0]])
            total += np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=SYMBOLS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities [a, b, c] of symbol c after a, b, interpolated with shorter contexts; the counts cover all texts."""
    counts = docs.select("text").mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    n = np.zeros(SYMBOLS**3)
    for r in counts.collect():  # at most 28^3 rows, whatever the input
        n[r.gram] = r.n
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = n.sum((0, 1)) + 1
    one /= one.sum()
    two = n.sum(0)
    two = (two + 5 * one) / (two.sum(1, keepdims=True) + 5)
    return np.log((n + 5 * two) / (n.sum(2, keepdims=True) + 5))


# ---- the channel


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each stretch of the token its readings, each with the channel's log probability."""
    out = []
    for m in re.finditer(r"([a-z])\1*|([^a-z])\2*", token):
        s = m[0]
        if m[1]:
            if len(s) == 1:
                out.append([(s, 0.0)])
            elif len(s) == 2:
                out.append([(s, 0.0), (s[0], SUBSTITUTE)])
            else:
                out.append([(s[0], REPEAT), (s[0] * 2, REPEAT + KEEP_TWO)])
        elif s[0] in LEET:
            options = [(x, SUBSTITUTE) for x in LEET[s[0]]]
            if len(s) > 1:
                options += [(x * 2, SUBSTITUTE + KEEP_TWO) for x in LEET[s[0]]]
            out.append(options)
        elif ord(s[0]) > 127:
            out.append([(s, 0.0)])
        # what is neither letter nor look-alike is a separator, and dropped
    return out


def decode(token: str, lm: np.ndarray, split: bool = False) -> str:
    """The likeliest reading, with blanks put in if ``split``: Viterbi over states of the last two symbols."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for k, options in enumerate(lattice(token)):
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        if split and k:
            options = options + [(" " + s, cost) for s, cost in options]
        for (a, b), (score, text) in best.items():
            for s, cost in options:
                x, y, total = a, b, score + cost
                for ch in s:
                    z = ord(ch) - 96 if "a" <= ch <= "z" else 0 if ch == " " else 27
                    total += lm[x, y, z]
                    x, y = y, z
                if (x, y) not in new or total > new[x, y][0]:
                    new[x, y] = (total, (text, s))
        best = new
    (a, b), (_, text) = max(best.items(), key=lambda x: x[1][0] + lm[x[0][0], x[0][1], 0])
    out = []
    while text:  # readings are linked backwards, so that long ones are not copied at each step
        text, s = text
        out.append(s)
    return "".join(reversed(out))


def collapsed(token: str) -> str:
    """The token with runs of a character cut to two, all that a reading keeps."""
    return re.sub(r"(.)\1{2,}", r"\1\1", token)


def hidden(token: str) -> bool:
    """Whether a word, lowered and trimmed, looks disguised."""
    if len(token) < 3 or not re.search("[a-z]", token):
        return False
    return bool(_REPEATED.search(token) or (any(c in LEET for c in token) and re.search(r"[a-z][^a-z]+[a-z]|^[^a-z\s]+[a-z]{2}|[a-z]{2}[^a-z\s]$", token)))


def restored(text: str, words: list[str], lm: np.ndarray, cache) -> list[str]:
    out = []
    for m in _SPACED.finditer(text):
        run = m[1].lower()
        s = re.sub(r"[ .\-_*]", "", run)
        if len(s) < 3:
            continue
        parts = [x for x in (re.sub(r"[ .\-_*]", "", x) for x in re.split(r"[ .\-_*]{2}", run)) if len(x) >= 3]
        tokens = ([s] if len(collapsed(s)) <= MAX_HIDDEN else []) + [x for x in parts if len(collapsed(x)) <= MAX_HIDDEN]
        read = [cache(x) for x in tokens] + cache(s, True).split()
        out += dict.fromkeys(read)  # a word that several readings have counts once
    for w in words:
        t = re.sub(r"([^A-Za-z0-9])\1+$", "", w.strip(_TRIM)).lower()
        if hidden(t):
            out.append(cache(t, len(collapsed(t)) > MAX_HIDDEN))
    return out


def _suspicious(buf: np.ndarray, w: C.Words) -> tuple[np.ndarray, np.ndarray]:
    """Masks over words: those to be decoded, and single characters and joined ones that may be a word strung out."""
    many = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    n = lambda c: c[w.end] - c[w.start]
    letters, signs = many(_LETTER[buf]), many(_LOOKALIKE[buf])
    low = C.LOWER[buf]
    triple = np.zeros(len(buf), bool)
    if len(buf) > 2:
        triple[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & _LETTER[buf[2:]]
    tripled = many(triple)
    size = w.end - w.start
    odd = (n(letters) > 0) & ((n(signs) > 0) | (n(tripled) > 0))
    strung = (size == 1) & (_LETTER[buf[w.start]] | _LOOKALIKE[buf[w.start]]) if len(size) else np.zeros(0, bool)
    run = strung.copy()
    if len(run) > 2:
        run = np.zeros(len(strung), bool)
        three = strung[:-2] & strung[1:-1] & strung[2:]
        run[:-2] |= three
    else:
        run[:] = False
    joints = many(_JOINT[buf])
    run |= n(joints) >= 2
    return odd, run


def _texts(column: pa.Array, lm: np.ndarray):
    """(lowered bytes, offsets, restored strings of each text) of some texts at a time."""
    cache = lru_cache(100_000)(lambda t, split=False: decode(t, lm, split))
    for _, _, buf, offs in C.texts(column, lower=False):
        w = C.Words(buf, offs, C.SPACE)
        odd, run = _suspicious(buf, w)
        odd_at, run_at = np.flatnonzero(odd), np.flatnonzero(run)
        of = lambda at: np.searchsorted(w.first, at, "right") - 1
        found: dict[int, list[str]] = {}
        for k, d in zip(odd_at, of(odd_at)):
            found.setdefault(int(d), []).append(buf[w.start[k] : w.end[k]].tobytes().decode())
        strung = set(of(run_at).tolist())
        fixed = [""] * (len(offs) - 1)
        for d in set(found) | strung:
            text = buf[offs[d] : offs[d + 1]].tobytes().decode() if d in strung else ""
            fixed[d] = " ".join(restored(text, found.get(d, []), lm, cache))
        yield C.LOWER[buf], offs, fixed


def _families(buf: np.ndarray, offs: np.ndarray):
    """Bucket numbers for each family of features, and each text's first word."""
    w = C.Words(buf, offs, C.NOT_ALNUM)
    return [(h & _MASK).astype(np.int64) for h in (w.hash, *(w.prefix(k) * C.U64(2 * k + 1) for k in PREFIXES))], w.first


def _all_features(buf, offs, fixed):
    a, at = _families(buf, offs)
    b, bt = [], None
    if any(fixed):
        bytes_ = [f.encode() for f in fixed]
        fo = np.concatenate([[0], np.cumsum([len(x) for x in bytes_])]).astype(np.int64)
        fb = C.LOWER[np.frombuffer(b"".join(bytes_), np.uint8)]
        b, bt = _families(fb, fo)
    return a, at, b, bt


def _frequencies(lm: np.ndarray):
    def run(batches):
        total = np.zeros((2, BUCKETS), np.int32)
        for b in batches:
            y, at_row = b.column(0).to_numpy(), 0
            for buf, offs, fixed in _texts(b.column(1), lm):
                fams, at, more, mt = _all_features(buf, offs, fixed)
                for d in range(len(offs) - 1):
                    got = [f[at[d] : at[d + 1]] for f in fams] + [f[mt[d] : mt[d + 1]] for f in more]
                    total[y[at_row + d], np.unique(np.concatenate(got))] += 1
                at_row += len(offs) - 1
        k = np.flatnonzero(total.any(0))
        for i in range(0, len(k), 100_000):
            s = k[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(total[0, s], pa.int64()), pa.array(total[1, s], pa.int64())], ["bucket", "n0", "n1"])

    return run


def _strongest(lm: np.ndarray, weight: np.ndarray, keep: tuple[str, ...] = ()):
    """The sum of each text's two heaviest words, a word weighing as its strongest feature; 0 where none counts."""

    def run(batches):
        for b in batches:
            out = []
            for buf, offs, fixed in _texts(b.column(1), lm):
                fams, at, more, mt = _all_features(buf, offs, fixed)
                who, what = [], []
                for families, first in ((fams, at), (more, mt)):
                    if families:
                        w = np.max([weight[f] for f in families], axis=0)
                        k = np.flatnonzero(w)
                        who.append(np.searchsorted(first, k, "right") - 1)
                        what.append(w[k])
                who, what = np.concatenate(who), np.concatenate(what)
                order = np.lexsort((-what, who))
                who, what = who[order], what[order]
                place = np.arange(len(who)) - np.searchsorted(who, who)
                out.append(np.bincount(who[place < STRONGEST], what[place < STRONGEST], minlength=len(offs) - 1).astype(np.float64))
            best = pa.array(np.concatenate(out) if out else np.zeros(0))
            yield pa.RecordBatch.from_arrays([b.column(0), best, *[b.column(c) for c in keep]], ["doc_id", "_best", *keep])

    return run


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton steps with a small ridge."""
    if len(x) == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return 0.0, float(np.log(p / (1 - p)))
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([(x * (y - p)).sum() - 0.1 * a, (y - p).sum() - 0.1 * b])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        da, db = np.linalg.solve(h, g)
        a, b = a + float(np.clip(da, -3, 3)), b + float(np.clip(db, -3, 3))
    return max(a, 0.0), b


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: tuple[int, int] = HELD_OUT, threshold: float = THRESHOLD, sample: int = SAMPLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted[, kept columns]), a row for each row of ``docs``.

    Null and empty texts have no features and score as the fitted curve says at zero. Repeated ids are scored apart; a null id is not held out and has no
    label. Without labels of both classes every text scores their smoothed share. Columns other than doc_id and text are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lm = character_model(rows)
    chosen = C.labelled_sample(spark, labels, label, held_out, sample).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)))
    chosen = C.Stage(spark, "toxic").table(chosen)
    known = rows.join(F.broadcast(chosen), "doc_id")
    counts = known.where("fold > 0").select("y", "text").mapInArrow(_frequencies(lm), "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    per = {r.y: r.n for r in known.where("fold > 0").groupBy("y").agg(F.count("*").alias("n")).collect()}
    bound = F.log((F.col("n1") + 0.5) / (per.get(1, 0) + 1)) - F.log((F.col("n0") + 0.5) / (per.get(0, 0) + 1)) - 1.5 * F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    weight = np.zeros(BUCKETS, np.float32)
    for r in counts.select("bucket", "n1", bound.alias("w")).where((F.col("n1") >= MIN_DOCS) & (F.col("w") >= MIN_WEIGHT)).toLocalIterator():  # BUCKETS rows at most
        weight[r.bucket] = r.w
    fold = known.where("fold = 0").select("y", "text").mapInArrow(_strongest(lm, weight), "doc_id int, _best double").collect()
    slope, at_zero = _curve(np.array([r._best for r in fold]), np.array([float(r.doc_id) for r in fold]))
    more = tuple(c for c in keep if c != "doc_id")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c for c in more if c != "text"])
    schema = "doc_id long, _best double" + "".join(f", {c} {t}" for c, t in whole.select(*more).dtypes)
    scored = whole.mapInArrow(_strongest(lm, weight, more), schema)
    score = 1 / (1 + F.exp(-(F.lit(slope) * F.col("_best") + F.lit(at_zero))))
    return scored.select("doc_id", C.held_out_flag(*held_out).alias("held_out"), score.alias("score"), *more).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark, C.read(spark, sf_dir, "documents", "doc_id", "text"), C.read(spark, sf_dir, "labels", "doc_id", "toxic"))
