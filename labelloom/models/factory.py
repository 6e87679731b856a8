"""Classifier name + parameters -> probability of y = 1 on other rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.models.bayes import fit_bayes
from labelloom.models.linear import fit_margin, logistic
from labelloom.models.neighbours import neighbours
from labelloom.models.trees import boosted, forest, single_tree


def fit_predict(
    clf: str, params: Mapping, train: DataFrame, valid: DataFrame, key: str, n_rows: int
) -> DataFrame:
    """(key, y, p) for ``valid``. Frames hold key, x (array), y (0/1), with one
    row per key; a training part without positives predicts 0, one without negatives 1."""
    sides = train.agg(F.min("y").alias("least"), F.max("y").alias("most")).first()
    if sides["least"] is not None and sides["least"] == sides["most"]:
        return valid.select(key, "y", F.lit(float(sides["most"])).alias("p"))
    if clf == "nb":
        model = fit_bayes(train, "x", "y")
        at = model.classes.index(1)
        return model.transform(valid).select(key, "y", F.get("probs", F.lit(at)).alias("p"))
    if clf == "knn":
        k, p = params["n_neighbors"], params.get("p", 2)
        near = neighbours(train, valid, key, "x", k, p)
        votes = train.select(F.col(key).alias("neighbour"), F.col("y").alias("__vote"))
        share = near.join(votes, "neighbour").groupBy(key).agg((F.sum("__vote") / k).alias("p"))
        return valid.select(key, "y").join(share, key)
    vec = array_to_vector(F.col("x"))
    train_v = train.select(F.col("y").cast("double").alias("y"), vec.alias("features"))
    valid_v = valid.select(key, F.col("y").alias("__y"), vec.alias("features"))
    if clf == "log_reg":
        model = logistic(params["C"], n_rows).fit(train_v)
    elif clf == "svm":
        d = len(train.select("x").first()[0])
        model = fit_margin(
            train_v, params["C"], n_rows, d, balanced=params.get("class_weight") == "balanced"
        )
    elif clf == "rf":
        model = forest(**params).fit(train_v)
    elif clf == "dt":
        model = single_tree(**params).fit(train_v)
    elif clf == "xgb":
        renamed = {"eta": "learning_rate", "lambda": "reg_lambda", "alpha": "reg_alpha"}
        model = boosted(**{renamed.get(k, k): v for k, v in params.items()}).fit(train_v)
    else:
        raise ValueError(f"unknown classifier {clf!r}")
    scored = model.transform(valid_v)
    return scored.select(key, F.col("__y").alias("y"), vector_to_array("probability")[1].alias("p"))
