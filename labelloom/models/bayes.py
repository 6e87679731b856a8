"""Gaussian naive Bayes: moments per class, one projection to score."""

from __future__ import annotations

from dataclasses import dataclass
from math import log, pi

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.arrays import let, literal, total
from labelloom.operators.moments import combine, fold_moments
from labelloom.roles import named

SMOOTHING = 1e-9  # fixed value: share of the largest feature variance added to all


@dataclass(frozen=True)
class BayesModel:
    column: str
    classes: list
    prior: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def proba(self) -> Column:
        """array<double> of class probabilities, in the order of ``classes``."""
        record = []
        for c in range(len(self.classes)):
            const = log(self.prior[c]) - 0.5 * float(np.log(2 * pi * self.var[c]).sum())
            cells = [{"m": float(m), "w": float(0.5 / v)} for m, v in zip(self.mean[c], self.var[c])]
            record.append({"c": const, "t": cells})
        table = literal(record, "array<struct<c double, t array<struct<m double, w double>>>>")
        x = named(self.column)
        joint = F.transform(
            table,
            lambda m: m["c"]
            - total(F.zip_with(x, m["t"], lambda v, t: (v - t["m"]) * (v - t["m"]) * t["w"])),
        )
        unscaled = let(joint, lambda j: let(F.array_max(j), lambda top: F.transform(j, lambda v: F.exp(v - top))))
        return let(unscaled, lambda e: let(total(e), lambda s: F.transform(e, lambda v: v / s)))

    def transform(self, df: DataFrame, name: str = "probs") -> DataFrame:
        return df.withColumn(name, self.proba())


def fit_bayes(train: DataFrame, column: str, label: str) -> BayesModel:
    per_class = fold_moments(train, column, label)
    classes = sorted(per_class)
    whole = combine(per_class.values())
    extra = SMOOTHING * float((whole.m2 / whole.n).max())
    parts = [per_class[c] for c in classes]
    return BayesModel(
        column,
        classes,
        np.array([m.n / whole.n for m in parts]),
        np.array([m.mean for m in parts]),
        np.array([m.m2 / m.n + extra for m in parts]),
    )
