"""Exact binomial confidence intervals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def _tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of Binomial(n, p)."""
    if p <= 0 or p >= 1:
        return float(k <= 0 or p >= 1)
    i = np.arange(k, n + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in i.tolist()])
    return float(np.exp(logs + i * math.log(p) + (n - i) * math.log1p(-p)).sum())


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float] | tuple[None, None]:
    """The interval of a share of k in n by bisection of the binomial tails; none for n = 0."""
    if n == 0:
        return None, None

    def solve(tail, goal: float) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if tail(mid) < goal else (lo, mid)
        return (lo + hi) / 2

    low = 0.0 if k == 0 else solve(lambda p: _tail(k, n, p), alpha / 2)
    high = 1.0 if k == n else solve(lambda p: _tail(k + 1, n, p), 1 - alpha / 2)
    return low, high


@F.pandas_udf(StructType([StructField("lo", DoubleType()), StructField("hi", DoubleType())]))
def interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Of aggregated rows, one for each segment."""
    return pd.DataFrame([clopper_pearson(int(a), int(b)) for a, b in zip(k, n, strict=True)], columns=["lo", "hi"])
