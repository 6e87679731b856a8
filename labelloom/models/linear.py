"""Linear classifiers on MLlib: logistic regression and a kernel margin classifier.

Frames hold ``features`` (vector) and a 0/1 column ``y``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def logistic(
    strength: float, n_rows: int, label: str = "y", max_iter: int = 500, tol: float = 1e-6
) -> LogisticRegression:
    """L2 logistic regression for the objective C * loss + |w|^2 / 2.

    MLlib minimises mean loss + regParam |w|^2 / 2, so regParam = 1 / (C n);
    the intercept is not penalised and features are taken as they come.
    """
    return LogisticRegression(
        featuresCol="features",
        labelCol=label,
        regParam=1.0 / (strength * n_rows),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=tol,
    )


def multinomial(
    strength: float, n_rows: int, label: str = "y", max_iter: int = 500, tol: float = 1e-6
) -> LogisticRegression:
    return logistic(strength, n_rows, label, max_iter, tol).setFamily("multinomial")


def gradient_norm(df: DataFrame, model: LogisticRegressionModel, strength: float) -> float:
    """Largest entry of the objective's gradient at the fitted coefficients,
    divided by the number of rows; close to 0 at the optimum."""
    p = vector_to_array(F.col("probability"))[1]
    scored = model.transform(df).select(
        array_to_vector(
            F.concat(
                F.transform(vector_to_array("features"), lambda v: v * (p - F.col("y"))),
                F.array(p - F.col("y")),
            )
        ).alias("g")
    )
    row = scored.select(Summarizer.mean(F.col("g")).alias("g"), F.count(F.lit(1)).alias("n")).first()
    g = row["g"].toArray()
    g[:-1] += model.coefficients.toArray() / (strength * row["n"])
    return float(np.abs(g).max())


def fourier_features(d: int, width: int, gamma: float, seed: int = 0):
    """Random Fourier features of the Gaussian kernel exp(-gamma |x - y|^2)
    (Rahimi & Recht 2007) as an Arrow UDF array<double> -> array<double>."""
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=np.sqrt(2 * gamma), size=(d, width))
    b = rng.uniform(0, 2 * np.pi, size=width)

    @F.pandas_udf("array<double>")
    def lift(x: pd.Series) -> pd.Series:
        z = np.sqrt(2.0 / width) * np.cos(np.vstack(x.to_numpy()) @ w + b)
        return pd.Series(list(z))

    return lift


@dataclass
class MarginModel:
    """Approximation of a Gaussian-kernel margin classifier with probabilities.

    The kernel is replaced by random features and the probability by a
    one-variable logistic fit on the margin, so results are near, not equal,
    to an exact kernel solver.
    """

    lift: object
    svc: LinearSVCModel
    calibration: LogisticRegressionModel

    def margin(self, df: DataFrame) -> DataFrame:
        lifted = df.withColumn("__z", array_to_vector(self.lift(vector_to_array("features"))))
        scored = self.svc.transform(lifted)
        return scored.withColumn("__m", vector_to_array("__raw")[1]).drop("__z", "__raw")

    def transform(self, df: DataFrame) -> DataFrame:
        with_vec = VectorAssembler(inputCols=["__m"], outputCol="__mv").transform(self.margin(df))
        return self.calibration.transform(with_vec).drop("__m", "__mv", "__calraw", "__calpred")


def fit_margin(
    train: DataFrame,
    strength: float,
    n_rows: int,
    n_features: int,
    gamma: float | None = None,
    balanced: bool = False,
    width: int = 256,
    max_iter: int = 100,
) -> MarginModel:
    """``gamma=None`` is one over the number of features; ``balanced`` weighs the
    classes by n / (2 n_class)."""
    lift = fourier_features(n_features, width, gamma or 1.0 / n_features)
    weight: Column = F.lit(1.0)
    if balanced:
        ones = train.agg(F.sum("y")).first()[0]
        weight = F.when(F.col("y") == 1, F.lit(n_rows / (2.0 * ones))).otherwise(
            F.lit(n_rows / (2.0 * (n_rows - ones)))
        )
    lifted = train.withColumn(
        "__z", array_to_vector(lift(vector_to_array("features")))
    ).withColumn("__w", weight)
    svc = LinearSVC(
        featuresCol="__z",
        labelCol="y",
        weightCol="__w",
        rawPredictionCol="__raw",
        predictionCol="__svcpred",
        regParam=1.0 / (strength * n_rows),
        standardization=False,
        maxIter=max_iter,
    ).fit(lifted)
    half = MarginModel(lift, svc, None)
    margins = VectorAssembler(inputCols=["__m"], outputCol="__mv").transform(half.margin(train))
    half.calibration = LogisticRegression(
        featuresCol="__mv",
        labelCol="y",
        probabilityCol="probability",
        rawPredictionCol="__calraw",
        predictionCol="__calpred",
    ).fit(margins)
    return half
