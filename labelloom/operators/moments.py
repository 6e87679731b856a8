"""Per-fold sums of packed features; training statistics come from the other folds.

One pass groups by fold. The statistics of "all folds but f" are combined from
the per-fold ones, so five training sets cost one scan instead of five.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.roles import named


@dataclass(frozen=True)
class Moments:
    n: int
    mean: np.ndarray
    m2: np.ndarray  # sum of squared deviations from the mean

    def std(self, ddof: int = 0) -> np.ndarray:
        return np.sqrt(self.m2 / (self.n - ddof))

    def spread(self, ddof: int = 0) -> np.ndarray:
        """Standard deviation with 1 in place of 0, so constant columns stay 0."""
        sd = self.std(ddof)
        return np.where(sd == 0, 1.0, sd)


def combine(parts: Iterable[Moments]) -> Moments:
    parts = [p for p in parts if p.n]
    n = sum(p.n for p in parts)
    mean = sum(p.n * p.mean for p in parts) / n
    m2 = sum(p.m2 + p.n * (p.mean - mean) ** 2 for p in parts)
    return Moments(n, mean, m2)


def fold_moments_of(
    df: DataFrame, columns: Sequence[str], by: str | None = None
) -> dict[str, dict[int, Moments]]:
    """Moments of several packed columns per value of ``by``, all in one pass."""
    part = named(by) if by else F.lit(0)
    metrics = Summarizer.metrics("count", "mean", "variance")
    aggs = [metrics.summary(array_to_vector(named(c))).alias(f"s{i}") for i, c in enumerate(columns)]
    complete = reduce(lambda a, b: a & b, [named(c).isNotNull() for c in columns])
    fields = []
    for i in range(len(columns)):
        fields += [
            F.col(f"s{i}.count").alias(f"n{i}"),
            vector_to_array(F.col(f"s{i}.mean")).alias(f"mean{i}"),
            vector_to_array(F.col(f"s{i}.variance")).alias(f"var{i}"),
        ]
    grouped = df.filter(complete).groupBy(part.alias("__by")).agg(*aggs)
    rows = grouped.select("__by", *fields).collect()  # one row per fold
    out: dict[str, dict[int, Moments]] = {c: {} for c in columns}
    for r in rows:
        for i, c in enumerate(columns):
            n, var = r[f"n{i}"], np.nan_to_num(np.array(r[f"var{i}"]))
            out[c][r["__by"]] = Moments(n, np.array(r[f"mean{i}"]), var * (n - 1))
    return out


def fold_moments(df: DataFrame, column: str, by: str | None = None) -> dict[int, Moments]:
    """Moments of a packed column per value of ``by`` (one entry, 0, without it)."""
    return fold_moments_of(df, [column], by)[column]


def moments(df: DataFrame, column: str) -> Moments:
    return fold_moments(df, column)[0]


def train_moments(per_fold: dict[int, Moments], fold: int) -> Moments:
    return combine(m for f, m in per_fold.items() if f != fold)


@dataclass(frozen=True)
class Gram:
    n: int
    total: np.ndarray  # sum of (x - shift)
    cross: np.ndarray  # sum of (x - shift)(x - shift)'

    def covariance(self) -> np.ndarray:
        m = self.total / self.n
        return self.cross / self.n - np.outer(m, m)


def fold_grams(
    df: DataFrame, column: str, shift: np.ndarray, by: str | None = None
) -> dict[int, Gram]:
    """Cross products per fold: numpy blocks inside the tasks, summed by Spark.

    Every task emits d + 1 vectors per fold, whatever its number of rows; the
    driver receives d x d numbers per fold.
    """
    d = len(shift)
    part = named(by).cast("int") if by else F.lit(0)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            x = np.vstack(pdf["x"].to_numpy()) - shift
            folds = pdf["by"].to_numpy()
            for f in np.unique(folds):
                xf = x[folds == f]
                ext = np.hstack([xf, np.ones((len(xf), 1))])
                g = ext.T @ ext
                acc[int(f)] = acc[int(f)] + g if int(f) in acc else g
        for f, g in acc.items():
            yield pd.DataFrame({"by": f, "i": np.arange(d + 1), "v": list(g)})

    rows = (
        df.filter(named(column).isNotNull())
        .select(part.alias("by"), named(column).alias("x"))
        .mapInPandas(blocks, "by int, i int, v array<double>")
        .groupBy("by", "i")
        .agg(Summarizer.sum(array_to_vector(F.col("v"))).alias("s"))
        .select("by", "i", vector_to_array("s").alias("v"))
        .collect()
    )
    full: dict[int, np.ndarray] = {}
    for r in rows:
        full.setdefault(r["by"], np.zeros((d + 1, d + 1)))[r["i"]] = r["v"]
    return {f: Gram(int(round(g[d, d])), g[d, :d], g[:d, :d]) for f, g in full.items()}


def combine_grams(parts: Iterable[Gram]) -> Gram:
    parts = list(parts)
    return Gram(
        sum(p.n for p in parts), sum(p.total for p in parts), sum(p.cross for p in parts)
    )
