"""Secret scans: fixed patterns, and a token-efficiency test that exposes random strings.

A string that a public tokenizer needs many tokens for, counted in characters per token, is unlike anything in natural text or code. Runs of
key characters that have both letters and digits are tested so, after known digests (plain hexadecimal of a digest's length, UUIDs) and
identifiers (words joined by underscores, hyphens or short numbers) are left out. Every text is scanned whole, in one pass, without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern published with that vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MIN_RUN, MAX_CHARS_PER_TOKEN = 20, 2.2

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
NEEDLES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\Z")
IDENTIFIER = re.compile(r"[_-]*[A-Za-z]+(?:[_/+=-]+[A-Za-z]+|[_/+=-]*[0-9]{1,4}(?![0-9]))*[_=/+-]*\Z")
ORDER = {"assign": 0, "access": 1, "hex": 2, "random": 3}

_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_KEY = np.zeros(256, bool)
_KEY[[43, 45, 47, 61, 95]] = True
_KEY[48:58] = _KEY[65:91] = _KEY[97:123] = True

_encoders: dict[str, object] = {}


def chars_per_token(s: str, vocabulary: str = VOCABULARY) -> float:
    if vocabulary not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary, "rb"))}
        _encoders[vocabulary] = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return len(s) / max(1, len(_encoders[vocabulary].encode_ordinary(s)))


def is_random(s: str, vocabulary: str = VOCABULARY, most: float = MAX_CHARS_PER_TOKEN) -> bool:
    core = s.strip("=_-+/")
    if len(core) < MIN_RUN or not re.search("[A-Za-z]", core) or not re.search("[0-9]", core) or DIGEST.match(core) or IDENTIFIER.match(core):
        return False
    return chars_per_token(core, vocabulary) < most


def _long_runs(mask: np.ndarray, offs: np.ndarray, least: int) -> np.ndarray:
    """(start, end) of runs of at least so many bytes; a run ends with its text."""
    inner = np.zeros(len(mask) + 1, bool)
    inner[offs] = True
    before = np.concatenate([[False], mask[:-1]]) if len(mask) else mask
    after = np.concatenate([mask[1:], [False]]) if len(mask) else mask
    start = np.flatnonzero(mask & (~before | inner[:-1]))
    end = np.flatnonzero(mask & (~after | inner[1:])) + 1
    long = end - start >= least
    return np.stack([start[long], end[long]], 1)


def _scan(vocabulary: str, most: float):
    def run(batches):
        for b in batches:
            kind, start, end, count = [], [], [], []
            for _, _, buf, offs in C.texts(b.column(1), lower=False):
                low = C.LOWER[buf].tobytes()
                has = np.zeros(len(offs) - 1, bool)
                for x in NEEDLES:
                    at = low.find(x)
                    while at >= 0:
                        d = int(np.searchsorted(offs, at, "right")) - 1
                        has[d] = True
                        at = low.find(x, int(offs[d + 1]))
                raw = buf.tobytes()
                keyed = np.zeros(len(offs) - 1, bool)
                at = raw.find(b"AKIA")
                while at >= 0:
                    d = int(np.searchsorted(offs, at, "right")) - 1
                    keyed[d] = True
                    at = raw.find(b"AKIA", int(offs[d + 1]))
                found: dict[int, list] = {}
                for s, e in _long_runs(_HEX[buf], offs, 32):
                    found.setdefault(int(np.searchsorted(offs, s, "right")) - 1, []).append((int(s), int(e), "hex"))
                digits = np.concatenate([[0], np.cumsum(_DIGIT[buf])])
                for s, e in _long_runs(_KEY[buf], offs, MIN_RUN):
                    if digits[e] > digits[s] and is_random(raw[s:e].decode(), vocabulary, most):
                        found.setdefault(int(np.searchsorted(offs, s, "right")) - 1, []).append((int(s), int(e), "random"))
                for d in range(len(offs) - 1):
                    spans = []
                    if d in found:
                        point = np.concatenate([[0], np.cumsum((buf[offs[d] : offs[d + 1]] & 0xC0) != 0x80)])
                        spans = [(int(point[s - offs[d]]), int(point[e - offs[d]]), k) for s, e, k in found[d]]
                    if has[d] or keyed[d]:
                        text = raw[offs[d] : offs[d + 1]].decode()
                        if has[d]:
                            spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
                        if keyed[d]:
                            spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
                    spans.sort(key=lambda x: (x[0], ORDER[x[2]], x[1]))
                    count.append(len(spans))
                    for s, e, k in spans:
                        start.append(s)
                        end.append(e)
                        kind.append(k)
            flat = pa.StructArray.from_arrays([pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["kind", "start", "end"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "spans"])

    return run


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, most: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """(doc_id, spans: array of kind, start, end in code points, by start, then kind), a row for each row of ``docs``.

    Kinds: assign, access, hex (the fixed patterns) and random (the token-efficiency test). Null and empty texts have no spans; rows that
    repeat an id are kept apart; other columns are ignored; an empty table gives an empty one."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan(vocabulary, most), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(C.read(spark, sf_dir, "documents", "doc_id", "text"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(told(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def brute(text: str | None) -> list[tuple[str, int, int]]:
    """The fixed patterns read plainly, character by character; what tests hold the scan against."""
    text = text or ""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]]))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
