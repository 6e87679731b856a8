"""Scored output: fit on all training rows, predict the test rows, write the template."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.rowstats import keep_argmax
from labelloom.models.ovr import fit_ovr, predictions_long, score_ovr
from labelloom.plans.recipe import Recipe
from labelloom.roles import HIDDEN


def _score(
    train: DataFrame,
    test: DataFrame,
    key: str,
    classes: Sequence[str],
    recipe: Recipe,
    strengths: Sequence[float],
    tol: float,
) -> DataFrame:
    fitted = recipe.fit(train)
    frame = recipe.matrix(fitted.transform(train), [key, *classes])
    model = fit_ovr(frame.withColumn("features", array_to_vector("x")), classes, strengths, tol)
    rows = recipe.matrix(fitted.transform(test), [key])
    return score_ovr(rows.withColumn("features", array_to_vector("x")), model)


def score_baseline(
    train: DataFrame,
    test: DataFrame,
    key: str,
    classes: Sequence[str],
    recipe: Recipe,
    tol: float = 1e-8,
) -> DataFrame:
    """Sparse predictions (key, label, p): only the largest probability of a row
    survives, the hidden class is dropped."""
    scored = _score(train, test, key, classes, recipe, [1.0] * len(classes), tol)
    kept = scored.withColumn("probs", keep_argmax(F.col("probs")))
    return drop_hidden(predictions_long(kept, key, classes))


def score_tuned(
    train: DataFrame,
    test: DataFrame,
    key: str,
    classes: Sequence[str],
    recipe: Recipe,
    strengths: dict[str, float],
    tol: float = 1e-8,
) -> DataFrame:
    """As the baseline with one strength per class, matched by name, no masking."""
    scored = _score(train, test, key, classes, recipe, [strengths[c] for c in classes], tol)
    return drop_hidden(predictions_long(scored, key, classes))


def drop_hidden(predictions: DataFrame, label: str = "label") -> DataFrame:
    return predictions.filter(F.col(label) != HIDDEN)


def control_rows_zero(
    predictions: DataFrame, categories: DataFrame, key: str, condition: Column
) -> DataFrame:
    """Predictions of control rows set to 0; the other rows keep theirs."""
    controls = categories.filter(condition).select(key, F.lit(True).alias("__c"))
    return predictions.join(controls, key, "left").withColumn(
        "p", F.when(F.col("__c"), F.lit(0.0)).otherwise(F.col("p"))
    ).drop("__c")


def submission_wide(
    predictions: DataFrame, template_keys: DataFrame, key: str, names: Sequence[str]
) -> DataFrame:
    """One row per template key, one column per label, 0 where nothing is predicted."""
    wide = predictions.groupBy(key).pivot("label", list(names)).agg(F.first("p"))
    return template_keys.select(key).join(wide, key, "left").fillna(0.0, list(names))
