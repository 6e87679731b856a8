"""Principal components of packed groups and the correlation matrix."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.arrays import project, scale
from labelloom.operators.moments import (
    Gram,
    Moments,
    combine,
    combine_grams,
    fold_grams,
    fold_moments,
    train_moments,
)
from labelloom.roles import named


@dataclass(frozen=True)
class PcaFit:
    center: np.ndarray
    spread: np.ndarray
    values: np.ndarray  # all eigenvalues, largest first
    axes: np.ndarray  # k x d, sign fixed: largest loading positive

    @property
    def shares(self) -> np.ndarray:
        return self.values / self.values.sum()


def _decompose(
    m: Moments, g: Gram, center: bool, scaled: bool, ddof: int, shift: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    spread = m.spread(ddof) if scaled else np.ones_like(m.mean)
    middle = m.mean if center else np.zeros_like(m.mean)
    cov = g.covariance()
    if not center:
        cov = cov + np.outer(m.mean, m.mean)
    cov = cov * (m.n / (m.n - ddof)) / np.outer(spread, spread)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    axes = vectors[:, order].T
    top = np.abs(axes).argmax(axis=1)
    axes = axes * np.sign(axes[np.arange(len(axes)), top])[:, None]
    return middle, spread, np.clip(values[order], 0, None), axes


def _cut(values: np.ndarray, k: int | None, threshold: float | None) -> int:
    if threshold is None:
        return k or len(values)
    shares = np.cumsum(values) / values.sum()
    return int(np.searchsorted(shares, threshold - 1e-12) + 1)


def fit_pca(
    df: DataFrame,
    column: str,
    k: int | None = 2,
    threshold: float | None = None,
    center: bool = True,
    scaled: bool = True,
    ddof: int = 0,
) -> PcaFit:
    """Fit on all rows: moments, then one pass of cross products; only d x d
    numbers leave the cluster."""
    m = combine(fold_moments(df, column).values())
    g = fold_grams(df, column, m.mean)[0]
    middle, spread, values, axes = _decompose(m, g, center, scaled, ddof, m.mean)
    return PcaFit(middle, spread, values, axes[: _cut(values, k, threshold)])


def fit_pca_folds(
    df: DataFrame,
    column: str,
    k: int | None = 2,
    fold: str = "kfold",
    scaled: bool = True,
    threshold: float | None = None,
    center: bool = True,
) -> dict[int, PcaFit]:
    """One fit per fold on the other folds, from two passes over all rows."""
    per_fold = fold_moments(df, column, fold)
    shift = combine(per_fold.values()).mean
    grams = fold_grams(df, column, shift, fold)
    fits = {}
    for f in per_fold:
        m = train_moments(per_fold, f)
        g = combine_grams(v for i, v in grams.items() if i != f)
        middle, spread, values, axes = _decompose(m, g, center, scaled, 0, shift)
        fits[f] = PcaFit(middle, spread, values, axes[: _cut(values, k, threshold)])
    return fits


def pca_scores(df: DataFrame, column: str, fit: PcaFit, prefix: str) -> DataFrame:
    """Append ``<prefix>1..k``: the rows projected on the fitted axes."""
    scores = project(scale(named(column), fit.center, fit.spread), fit.axes)
    out = df.withColumn("__pc", scores)
    cols = [F.get("__pc", F.lit(i)).alias(f"{prefix}{i + 1}") for i in range(len(fit.axes))]
    return out.select(*[named(c) for c in df.columns], *cols)


def pca_features(
    df: DataFrame, groups: Sequence[str], k: int = 2, train: DataFrame | None = None
) -> DataFrame:
    """First ``k`` scores of every group, fitted on ``train`` (default: the rows themselves)."""
    out = df
    for g in groups:
        out = pca_scores(out, g, fit_pca(train if train is not None else df, g, k), f"{g}_pc")
    return out


def pca_report(df: DataFrame, column: str, fit: PcaFit, axes: int = 2) -> DataFrame:
    """(axis, eigenvalue, share, variable, coordinate, contribution), one row per
    variable and axis; contributions of an axis add up to 100."""
    rows = []
    for a in range(axes):
        for i, w in enumerate(fit.axes[a]):
            rows.append(
                (
                    a + 1,
                    float(fit.values[a]),
                    float(fit.shares[a]),
                    f"{column}-{i}",
                    float(w * np.sqrt(fit.values[a])),
                    float(100 * w * w),
                )
            )
    schema = "axis int, eigenvalue double, share double, variable string, coordinate double, contribution double"
    return df.sparkSession.createDataFrame(rows, schema)


def variance_shares(df: DataFrame, fit: PcaFit, first: int = 5) -> DataFrame:
    rows = [
        (i + 1, float(fit.values[i]), float(fit.shares[i])) for i in range(min(first, len(fit.values)))
    ]
    return df.sparkSession.createDataFrame(rows, "axis int, eigenvalue double, share double")


def scores_by_group(scores: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    """Mean and spread of the scores per level of a category."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd")]
    return scores.groupBy(by).agg(*aggs)


def corr_matrix(df: DataFrame, column: str, prefix: str | None = None) -> DataFrame:
    """Lower triangle of the Pearson matrix over complete rows: (i, j, r), i > j."""
    complete = df.filter(
        named(column).isNotNull() & ~F.exists(named(column), lambda v: v.isNull())
    )
    vec = complete.select(array_to_vector(named(column)).alias("v"))
    r = Correlation.corr(vec, "v").first()[0].toArray()
    i, j = np.tril_indices(len(r), -1)
    pdf = pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "r": r[i, j]})
    return df.sparkSession.createDataFrame(pdf, "i int, j int, r double")
