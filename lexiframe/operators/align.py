"""Dynamic time warping of pairs of short sequences, and contours warped along the path."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import signal as S


def dtw(a: np.ndarray, b: np.ndarray, band: float = 0.15) -> tuple[list[tuple[int, int]], float]:
    """Path and cost within a band around the unscaled diagonal; ties go diagonal, up, left. An end outside the band costs infinity."""
    a, b = np.atleast_2d(np.asarray(a, float).T).T, np.atleast_2d(np.asarray(b, float).T).T
    n, m = len(a), len(b)
    r = max(1, int(band * max(n, m)))
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, n + 1):
        lo, hi = max(1, i - r), min(m, i + r)
        if lo > hi:
            continue
        cost = np.sqrt(((a[i - 1] - b[lo - 1 : hi]) ** 2).sum(1))
        up = np.minimum(d[i - 1, lo - 1 : hi], d[i - 1, lo : hi + 1])
        left = d[i, lo - 1]
        for k in range(hi - lo + 1):
            left = cost[k] + min(up[k], left)
            d[i, lo + k] = left
    path, i, j = [], n, m
    while i > 0 and j > 0:
        path.append((i - 1, j - 1))
        step = int(np.argmin([d[i - 1, j - 1], d[i - 1, j], d[i, j - 1]]))
        i, j = (i - 1, j - 1) if step == 0 else (i - 1, j) if step == 1 else (i, j - 1)
    return path[::-1], float(d[n, m])


_KIND = T.StructType([T.StructField("path", T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))), T.StructField("cost", T.DoubleType())])
_ARROW = pa.struct([("path", pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))), ("cost", pa.float64())])


def dtw_pairs(df: DataFrame, a: str, b: str, band: float = 0.15, out: str = "dtw") -> DataFrame:
    """``df`` with path and cost of two array columns (scalars, or arrays of features); each pair by itself, nothing shuffled. Null or empty gives null."""

    def run(batches):
        for x in batches:
            got = []
            for p, q in zip(x.column(a).to_pylist(), x.column(b).to_pylist()):
                if not p or not q:
                    got.append(None)
                    continue
                path, cost = dtw(np.array(p, float), np.array(q, float), band)
                got.append({"path": [{"i": i, "j": j} for i, j in path], "cost": cost})
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(got, _ARROW)], [*x.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, _KIND)]))


def contour_features(f0: Column, energy: Column) -> Column:
    """Logarithms with floors of 0.001 and 0.000001."""
    return F.zip_with(S.doubles(f0), S.doubles(energy), lambda f, e: F.array(F.log(F.greatest(f, F.lit(1e-3))), F.log(F.greatest(e, F.lit(1e-6)))))


def path_means(path: Column, source: Column, n: Column) -> Column:
    """For each target index the mean of the source values that the path joins it with."""

    def means(s: Column) -> Column:
        def mean(j: Column) -> Column:
            own = F.transform(F.filter(s["path"], lambda p: p["j"] == j), lambda p: F.get(s["source"], p["i"]).cast("double"))
            return S.let(own, lambda x: F.try_divide(S.total(x), F.size(x)))

        return F.transform(F.sequence(F.lit(0), n - 1), mean)

    return S.let(F.struct(path.alias("path"), source.alias("source")), means)


def warp_contours(df: DataFrame, src_f0: str, src_e: str, tgt_f0: str, tgt_e: str, most: int = 600, band: float = 0.2) -> DataFrame:
    """``df`` with warped_f0 and warped_energy: the source's contours along the path to the target, on the target's frames.

    Both are thinned to ``most`` frames for the path, and brought back to all frames by linear interpolation."""
    at = lambda v, ix: S.let(v, lambda w: F.transform(ix, lambda i: F.get(w, i)))
    c = F.col
    out = df.withColumn("_si", S.pick_indices(F.size(src_f0), most)).withColumn("_ti", S.pick_indices(F.size(tgt_f0), most))
    out = out.withColumn("_sf", S.interp_unvoiced(c(src_f0))).withColumn("_tf", S.interp_unvoiced(c(tgt_f0)))
    out = out.withColumn("_a", contour_features(at(c("_sf"), c("_si")), at(c(src_e), c("_si")))).withColumn("_b", contour_features(at(c("_tf"), c("_ti")), at(c(tgt_e), c("_ti"))))
    out = dtw_pairs(out, "_a", "_b", band, "_d")
    full = lambda v: S.interpolate(c("_ti"), path_means(c("_d.path"), at(v, c("_si")), F.size("_ti")), F.size(tgt_f0))
    out = out.withColumn("warped_f0", full(c("_sf"))).withColumn("warped_energy", full(c(src_e)))
    return out.drop("_si", "_ti", "_sf", "_tf", "_a", "_b", "_d")
