"""Models as pluggable scorers, and what is done around them: batching, argmax, smoothing, robustness search.

No weights ship with this library; a scorer is any function from a matrix of features to a matrix of scores. ``LinearScorer`` is one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Scorer = Callable[[np.ndarray], np.ndarray]


class LinearScorer:
    """softmax(w x + b); its input gradient is known in closed form."""

    def __init__(self, w: np.ndarray, b: np.ndarray):
        self.w, self.b = np.asarray(w, float), np.asarray(b, float)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.w.T + self.b
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def gradient(self, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the loss towards ``target``."""
        p = self(x)
        p[np.arange(len(x)), target] -= 1
        return p @ self.w


def score(df: DataFrame, features: str, scorer: Scorer, out: str = "scores", skip: Column | None = None) -> DataFrame:
    """``df`` with the scorer's output; rows for which ``skip`` holds never reach it and get null. Batches are Arrow's."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    work = df if skip is None else df.where(~F.coalesce(skip, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            col = b.column(features)
            n = b.num_rows
            x = np.array([np.asarray(v.as_py(), float) for v in col]) if n else np.zeros((0, 1))
            y = scorer(x) if n else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tolist() for r in y], pa.list_(pa.float64()))], [*b.schema.names, out])

    scored = work.mapInArrow(run, schema)
    if skip is None:
        return scored
    rest = df.where(F.coalesce(skip, F.lit(False))).withColumn(out, F.lit(None).cast("array<double>"))
    return scored.unionByName(rest)


def argmax(scores: Column) -> Column:
    """The first of the largest."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def two_way(p_first: Column, p_second: Column, first: str, second: str) -> Column:
    """Ties go to the first."""
    return F.when(p_first >= p_second, first).otherwise(second)


def least_epsilon(x: np.ndarray, scorer: LinearScorer, target: int, steps: int = 18, lo: float = 1e-5, hi: float = 0.1, min_snr: float = 40.0) -> tuple[float, bool, float]:
    """Bisection for the least signed-gradient step that flips the prediction at ``min_snr`` decibels or more: (epsilon, flipped, snr).

    A step that flips, but too loudly, moves the search up like one that does not flip. If no step passes, the last upper bound is returned as it is."""
    sign = np.sign(scorer.gradient(x[None], np.array([target]))[0])

    def attempt(eps: float) -> tuple[bool, float]:
        y = np.clip(x - eps * sign, -1, 1)
        snr = 10 * np.log10(((x * x).sum() + 1e-12) / (((y - x) ** 2).sum() + 1e-12))
        return int(scorer(y[None])[0].argmax()) == target, float(snr)

    best = None
    for _ in range(steps):
        mid = (lo + hi) / 2
        flipped, snr = attempt(mid)
        if flipped and snr >= min_snr:
            best, hi = (mid, True, snr), mid
        else:
            lo = mid
    return best or (hi, *attempt(hi))


def robustness(df: DataFrame, features: str, scorer: LinearScorer, target: int, **options) -> DataFrame:
    """``df`` with (epsilon, flipped, snr_db) of each row."""
    @F.pandas_udf("struct<epsilon:double,flipped:boolean,snr_db:double>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([least_epsilon(np.asarray(v, float), scorer, target, **options) for v in s], columns=["epsilon", "flipped", "snr_db"])

    return df.withColumn("robustness", run(F.col(features)))
