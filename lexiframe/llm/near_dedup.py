"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact confirmation, connected components.

Plan. (1) One pass over the texts gives every document the size and a 128-bit digest of its shingle set, 125 minima of universal hash
functions and 25 band keys of five minima each. (2) Documents of equal sets are one class; only its least id goes on. (3) Within each band
bucket all classes are compared with the bucket's leader, never with each other: the number of pairs is that of the rows. Leaders are
drawn by three seeds, dealt over the bands, so that a class seldom has one leader only. (4) What the verified links join is one component. A bucket
whose members are of one component is done. Members outside the main component of another bucket meet the sets of all such buckets by prefixes:
of two sets that reach the threshold, each has a common shingle among its few rarest, so that a set meets others that share its rare shingles, not its whole group.
A set with too few shingles that any other of these has can reach no threshold and meets none. Those that meet are told apart by parity bitmaps: two sets differ in as many
shingles as their bitmaps differ in bits, or more, so that no pair beyond a link's difference goes further.
So every pair of different sets that share a band is compared, unless already joined by links or proven apart. (5) Components by large-star and small-star.

With similarity s a pair shares a band with probability 1 - (1 - s^5)^25, over 0.999999 at 0.85.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .graph import connected_components

_LANES = 2048
#: Leaders with more partners than this are spread over SALTS copies.
HOT, SALTS = 512, 16
#: Seeds by which buckets draw their leaders.
LEADERS = 3
#: 64-bit words of a parity bitmap.
MAP_WORDS = 16


class Params:
    def __init__(self, width: int = 5, threshold: tuple[int, int] = (80, 100), bands: int = 25, rows: int = 5, seed: int = 7):
        self.width, self.num, self.den, self.bands, self.rows = width, *threshold, bands, rows
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**63, (bands * rows, 1), dtype=np.uint64) * C.U64(2) + C.U64(1)
        self.b = rng.integers(0, 2**63, (bands * rows, 1), dtype=np.uint64)

    def minima(self, s: np.ndarray) -> np.ndarray:
        """Multiply-add-shift: the top 32 bits of a * x + b."""
        out = np.full(len(self.a), 2**32 - 1, np.uint64)
        for i in range(0, len(s), _LANES):
            out = np.minimum(out, ((self.a * s[None, i : i + _LANES] + self.b) >> C.U64(32)).min(axis=1))
        return out

    def keys(self, sig: np.ndarray) -> np.ndarray:
        m = sig.reshape(self.bands, self.rows)
        h = np.arange(self.bands, dtype=np.uint64)
        for k in range(self.rows):
            h = C.mix(h * C.U64(0x9FB21C651E98DF25) + m[:, k])
        return h


def _sets(column: pa.Array, width: int):
    for lo, hi, buf, offs in C.texts(column):
        w = C.Words(buf, offs, C.SPACE)
        for d in range(hi - lo):
            yield np.unique(C.shingles(w.hash[w.first[d] : w.first[d + 1]], width))


def _signatures(p: Params):
    def run(batches):
        for b in batches:
            ids, n, hi, lo, sig, keys = [], [], [], [], [], []
            for i, s in zip(b.column(0).to_pylist(), _sets(b.column(1), p.width)):
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                ids.append(i)
                n.append(len(s))
                hi.append(int.from_bytes(digest[:8], "big", signed=True))
                lo.append(int.from_bytes(digest[8:], "big", signed=True))
                m = p.minima(s) if len(s) else np.zeros(0, np.uint64)
                sig.append((m >> C.U64(16)).astype(np.uint16).view(np.int16))  # equal minima stay equal
                keys.append(C.signed(p.keys(m)) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), C.ragged(sig, pa.int16()), C.ragged(keys, pa.int64())], ["doc_id", "n_shingles", "hi", "lo", "sig", "bands"])

    return run


def parity(s: np.ndarray) -> np.ndarray:
    """A bitmap in which each shingle turns one bit. Sets that differ in d shingles have bitmaps that differ in d bits at most."""
    h = C.mix(s)
    odd = np.bincount((h % C.U64(64 * MAP_WORDS)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _full_sets(p: Params):
    def run(batches):
        for b in batches:
            sets = list(_sets(b.column(1), p.width))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), C.ragged([C.signed(s) for s in sets], pa.int64()), C.ragged([parity(s) for s in sets], pa.int64())], ["id", "set", "map"])

    return run


def _with_hot(pairs: DataFrame, side: DataFrame, key: str, value: str, name: str, sizes: DataFrame) -> DataFrame:
    """pairs joined with ``side`` on ``key``; partners of hot keys are dealt over salts, for which the few hot rows of ``side`` are repeated."""
    hot = sizes.where(F.col("count") > HOT).select(F.col(key).alias("id"), F.lit(True).alias("hot"))
    salted = side.join(hot, "id", "left").select("id", F.col(value).alias(name), F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    marked = pairs.join(hot.withColumnRenamed("id", key), key, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    return marked.join(salted.withColumnRenamed("id", key), [key, "salt"]).drop("salt")


def _links(pairs: DataFrame, sigs: DataFrame, p: Params, few: bool) -> DataFrame:
    """(a, b) of the distinct pairs that reach the threshold: by signatures first, six standard errors below it, then on full sets."""
    t, lanes = p.num / p.den, p.bands * p.rows
    least = int(lanes * max(0.0, t - 6 * (t * (1 - t) / lanes) ** 0.5))

    def of(side: DataFrame, which: DataFrame) -> DataFrame:
        """Of a few pairs only the rows that they need are dealt out."""
        return side.join(which.select(F.col("a").alias("id")).unionByName(which.select(F.col("b").alias("id"))).distinct(), "id", "left_semi") if few else side

    own = of(sigs, pairs)
    sized = _with_hot(pairs, own, "b", "sig", "sig_b", pairs.groupBy("b").count()).join(own.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
    same = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return sized.where(same >= least).select("a", "b")


def _confirmed(near: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    own = sets.join(near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct(), "id", "left_semi")
    full = _with_hot(near, own, "b", "set", "set_b", near.groupBy("b").count()).join(own.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    full = full.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("inter"), (F.size("set_a") + F.size("set_b")).cast("long").alias("total"))
    return full.where(F.expr(f"{p.den} * inter >= {p.num} * (total - inter)")).select("a", "b")


def _merge(spark: SparkSession, roots: DataFrame, links: DataFrame, stage: C.Stage) -> DataFrame:
    """(id, root) after further links: components of the components."""
    of = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
    joined = links.join(of("a"), "a").join(of("b"), "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    up = connected_components(spark, joined, stage).select(F.col("node").alias("root"), F.col("root").alias("up"))
    return roots.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root"))


def _prefixes(sets: DataFrame, p: Params) -> DataFrame:
    """(id, n, room, map, token, at) of the first n - ceil(t n) + 1 shingles of each set, rarest among these sets first.

    room: how many shingles of the set any other has. Shingles that no other has are counted in ``at`` but left out, and so are sets whose room is below the
    least that a link shares, t n."""
    every = sets.select("id", F.size("set").cast("long").alias("n"), F.explode("set").alias("x"))
    counted = every.join(every.groupBy("x").agg(F.count("*").alias("c")).where("c > 1"), "x")
    own = counted.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("c", "x"))).alias("xs")).withColumn("room", F.size("xs").cast("long"))
    own = own.where(F.expr(f"{p.den} * room >= {p.num} * n"))
    first = F.slice("xs", 1, F.expr(f"cast(greatest(0, room - ceil({p.num} * n / {p.den}) + 1) as int)"))
    own = own.select("id", "n", "room", F.transform(first, lambda s: s["x"]).alias("xs"))
    own = own.select("id", "n", "room", F.posexplode("xs").alias("k", "token")).withColumn("at", F.expr("n - room + k + 1")).drop("k")
    return own.join(sets.select("id", "map"), "id")


def near_duplicates(spark: SparkSession, docs: DataFrame, params: Params | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Words are runs without ASCII white space, A-Z lowered. A null, empty or wordless text has no shingles, is linked with nothing and kept.
    Fewer words than the width make one shingle. Rows that repeat an id are taken as they are, each with that id; a null id keeps its own row
    as component null. An empty table gives an empty one. Other columns are ignored."""
    p = params or Params()
    stage = C.Stage(spark, "near")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seen = stage.table(base.mapInArrow(_signatures(p), "doc_id long, n_shingles long, hi long, lo long, sig array<smallint>, bands array<long>"))
    some = seen.where("n_shingles > 0 and doc_id is not null")
    classes = stage.table(some.groupBy("hi", "lo").agg(F.min("doc_id").alias("id"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("sig", "doc_id").alias("sig")))
    every = classes.select("id", F.posexplode("bands").alias("band", "bucket"))
    draw = F.xxhash64("id", F.col("band") % LEADERS)
    shared = stage.table(every.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("id", F.struct(draw, "id")).alias("b")).where("n > 1").select("bucket", "b"))
    rows = stage.table(every.drop("band").join(shared, "bucket"))  # both sides are dealt out for the join alone, so that a hot bucket can be split
    stage.drop(shared)
    touched = stage.table(rows.select("id").distinct())
    cand = C.only(base, touched.withColumnRenamed("id", "doc_id"), "doc_id")
    sets = stage.table(cand.mapInArrow(_full_sets(p), "id long, set array<long>, map array<long>").dropDuplicates(["id"]))
    sigs = stage.table(classes.join(touched, "id", "left_semi").select("id", "sig"))

    def verified(pairs: DataFrame, few: bool) -> DataFrame:
        pairs = stage.table(pairs)
        near = stage.table(_links(pairs, sigs, p, few))
        stage.drop(pairs)
        links = stage.table(_confirmed(near, sets, p))
        stage.drop(near)
        return links

    links = verified(rows.where("id <> b").select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct(), False)
    roots = stage.table(_merge(spark, touched.select("id", F.col("id").alias("root")), links, stage))
    here = stage.table(rows.select("bucket", "id").join(roots, "id"))
    stage.drop(rows)
    mixed = stage.table(here.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket"))
    old, here = here, stage.table(here.join(mixed, "bucket").select("bucket", "id", "root"))
    stage.drop(old)
    if not here.isEmpty():
        main = stage.table(here.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max_by("root", F.struct("count", "root")).alias("main")))
        apart = here.join(main, "bucket").where("root <> main").select("id").distinct()
        members = stage.table(here.select("id", "root").distinct())
        prefixes = _prefixes(sets.join(members, "id", "left_semi"), p).join(members, "id")
        prefixes = stage.table(prefixes.join(apart.withColumn("apart", F.lit(True)), "id", "left").withColumn("apart", F.coalesce("apart", F.lit(False))))
        x = prefixes.where("apart").select("token", F.col("id").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("at").alias("ax"), F.col("room").alias("roomx"), F.col("map").alias("mapx"))
        # two sets that reach the threshold share so many shingles that each has one of them among its first n - shared + 1, no more can be shared than are
        # not alone, and what they do not share is all that their bitmaps may differ in
        shared = f"ceil({p.num} * (n + nx) / {p.num + p.den})"
        differ = " + ".join(f"bit_count(map[{k}] ^ mapx[{k}])" for k in range(MAP_WORDS))
        met = x.join(prefixes, "token").where(F.expr(f"root <> rx AND (NOT apart OR id < x) AND least(room, roomx) >= {shared} AND at <= n - {shared} + 1 AND ax <= nx - {shared} + 1 AND {differ} <= n + nx - 2 * {shared}"))
        links = verified(met.select(F.greatest("id", "x").alias("a"), F.least("id", "x").alias("b")).distinct(), True)
        stage.drop(prefixes)
        roots = stage.table(_merge(spark, roots, links, stage))
    stage.drop(here)
    stage.drop(sets)
    stage.drop(sigs)
    roots = roots.select(F.col("id").alias("node"), "root")
    # copies of a set follow their class
    member = classes.select("hi", "lo", "id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("hi", "lo", F.coalesce("root", "id").alias("root"))
    out = seen.join(member, ["hi", "lo"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, C.read(spark, sf_dir, "documents", "doc_id", "text"), Params(width=3, threshold=(85, 100)))


#: Words and shingles by DuckDB, all pairs that share a shingle, and reachability from each document.
OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS d, doc_id AS o FROM documents UNION SELECT e.b, r.o FROM r JOIN e ON e.a = r.d)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.o)::BIGINT AS component_id, min(r.o) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.d = d.doc_id GROUP BY d.doc_id, n.n
"""
