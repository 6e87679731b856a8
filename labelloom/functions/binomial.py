"""Bounds of a binomial share for a handful of aggregated rows."""

from __future__ import annotations

import sys
from math import exp, lgamma, log

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

# ship the helpers below with the UDF, so executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / ((1.0 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 1_000_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            d = 1.0 / ((1.0 + term * d) or tiny)
            c = (1.0 + term / c) or tiny
            step = c * d
            h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_share(b, a, 1.0 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    return front * _beta_fraction(a, b, x)


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        if beta_share(a, b, mid) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def bounds_udf(level: float):
    """(lower, upper) Arrow UDFs over hit count and row count."""
    tail = (1 - level) / 2

    def lower_one(x: int, n: int) -> float:
        return 0.0 if x == 0 else beta_quantile(tail, x, n - x + 1)

    def upper_one(x: int, n: int) -> float:
        return 1.0 if x == n else beta_quantile(1 - tail, x + 1, n - x)

    @F.pandas_udf("double")
    def lower(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([lower_one(a, b) for a, b in zip(x, n)], dtype="float64")

    @F.pandas_udf("double")
    def upper(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([upper_one(a, b) for a, b in zip(x, n)], dtype="float64")

    return lower, upper
