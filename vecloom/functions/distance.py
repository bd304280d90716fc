"""Distances between vectors: as Columns for SQL, and as numpy kernels for Arrow batches.

Both accumulate in double precision; L2 is the root of the summed squares, cosine is 1 for a vector
of norm 0, dot is the negative inner product.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import Metric


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, t: s + t)


def distance(metric: Metric | str, a: Column, b: Column) -> Column:
    """Double; null if either is null."""
    metric = Metric.parse(metric)
    if metric is Metric.L2:
        gap = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
        return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, t: s + t))
    if metric is Metric.DOT:
        return F.lit(0.0) - _dot(a, b)
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norms == 0, F.lit(1.0)).otherwise(F.lit(1.0) - _dot(a, b) / norms)


def rounded(score: Column) -> Column:
    """For comparison between engines: six digits, no negative zero."""
    return F.round(score, 6) + F.lit(0.0)


def scores(metric: Metric, corpus: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """(queries x corpus) distances by the same formulas, in float64."""
    x, q = corpus.astype(np.float64), queries.astype(np.float64)
    if metric is Metric.L2:
        out = np.empty((len(q), len(x)))
        for i, one in enumerate(q):  # differences, not |x|^2 + |q|^2 - 2xq, which cancels near 0
            gap = x - one
            out[i] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        return out
    inner = q @ x.T
    if metric is Metric.DOT:
        return 0.0 - inner
    norms = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norms == 0, 1.0, 1.0 - inner / norms)
