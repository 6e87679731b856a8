"""The whole workflow over a feature table, a 0/1 label table and a test table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.operators.results import best_classifier, best_params, fold_mean
from labelloom.operators.splits import multilabel_stratified_kfold, stratified_kfold
from labelloom.operators.targets import (
    label_from_onehot,
    ovr_targets,
    positives_from_wide,
    topk_classes,
)
from labelloom.plans.recipe import Combine, CountEncode, OneHot, Pca, Recipe, RowStats, Scale
from labelloom.plans.scoring import score_baseline, score_tuned, submission_wide
from labelloom.plans.search import grid_search
from labelloom.roles import Roles, pack
from labelloom.session import settle


@dataclass(frozen=True)
class Labels:
    """Sparse positives (key, label) and the label names in column order."""

    positives: DataFrame
    names: list[str]
    keys: DataFrame

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.names)), "pos int, label string")


def load_features(table: DataFrame, roles: Roles) -> DataFrame:
    """Wide table to packed groups, written once as a columnar table: later
    passes read arrays instead of parsing hundreds of text columns again."""
    return settle(pack(table, roles))


def load_labels(table: DataFrame, key: str) -> Labels:
    names = [c for c in table.columns if c != key]
    return Labels(settle(positives_from_wide(table, key, names)), names, table.select(key))


def base_recipe(roles: Roles) -> Recipe:
    return Recipe(
        [OneHot(roles.categoricals), Scale(roles.groups)], ["onehot", *roles.groups]
    )


def feature_recipes(roles: Roles) -> list[tuple[str, Recipe]]:
    """The feature steps added one after the other: row statistics, combined
    category, level counts, components."""
    cats, groups = list(roles.categoricals), list(roles.groups)
    stats, combine, combined = RowStats(groups), Combine(cats), [*cats, "combined"]
    counts = [f"{c}_counts" for c in combined]
    pcs = [f"pc{g}" for g in groups]
    wide = [*groups, "stats"]
    return [
        ("baseline", base_recipe(roles)),
        ("row statistics", Recipe([stats, OneHot(cats), Scale(wide)], ["onehot", *wide])),
        (
            "combined category",
            Recipe([stats, combine, OneHot(combined), Scale(wide)], ["onehot", *wide]),
        ),
        (
            "level counts",
            Recipe(
                [stats, combine, OneHot(combined), CountEncode(combined), Scale(wide, scalars=counts)],
                ["onehot", *wide, "scalars"],
            ),
        ),
        (
            "components",
            Recipe(
                [
                    stats,
                    combine,
                    OneHot(combined),
                    CountEncode(combined),
                    Pca(groups),
                    Scale([*wide, *pcs], scalars=counts),
                ],
                ["onehot", *wide, *pcs, "scalars"],
            ),
        ),
    ]


def chosen_classes(features: DataFrame, labels: Labels, key: str, k: int = 12) -> list[str]:
    vocab = labels.vocabulary(features.sparkSession)
    top = topk_classes(features, labels.positives, vocab, key, k)
    return [r["label"] for r in top.collect()]  # k + 1 names


def fold_table(
    features: DataFrame,
    labels: Labels,
    key: str,
    k: int = 5,
    seed: int | None = 0,
    empty: str | None = "hidden",
) -> DataFrame:
    """Features with one collapsed ``target`` per row and a stratified ``kfold``."""
    vocab = labels.vocabulary(features.sparkSession)
    target = label_from_onehot(features, labels.positives, vocab, key, empty)
    folds = stratified_kfold(target.withColumnRenamed("label", "target"), key, "target", k, seed)
    return features.join(folds, key)


def search_frame(
    features: DataFrame, labels: Labels, key: str, classes: Sequence[str], seed: int | None = 0
) -> DataFrame:
    """Features, balanced folds and one 0/1 column per class, written once."""
    folds = multilabel_stratified_kfold(features, labels.positives, key, 5, seed)
    y = ovr_targets(features, labels.positives, key, classes)
    return settle(features.join(folds, key).join(y, key))


@dataclass(frozen=True)
class Selection:
    results: DataFrame  # every fold
    means: DataFrame  # per combination
    per_classifier: DataFrame  # best parameters of each classifier
    best: DataFrame  # best classifier of each class


def select_models(
    frame: DataFrame,
    key: str,
    classes: Sequence[str],
    recipe: Recipe,
    grid: Mapping[str, Mapping[str, Sequence]],
    results_path: str | None = None,
    compat: bool = False,
) -> Selection:
    results = grid_search(frame, key, classes, recipe, grid, results_path=results_path)
    means = fold_mean(results, ["class", "clf", "ordinal", "params"])
    per_classifier = best_params(means)
    return Selection(results, means, per_classifier, best_classifier(per_classifier, compat))


def tuned_strengths(per_classifier: DataFrame) -> dict[str, float]:
    """Best C of the logistic regression per class, matched by name."""
    rows = per_classifier.filter(F.col("clf") == "log_reg").select(
        "class", F.regexp_extract("params", r"C=([^,]+)", 1).cast("double").alias("c")
    )
    return {r["class"]: r["c"] for r in rows.collect()}


def scored_output(
    features: DataFrame,
    labels: Labels,
    test: DataFrame,
    key: str,
    classes: Sequence[str],
    recipe: Recipe,
    strengths: dict[str, float] | None = None,
) -> DataFrame:
    """One row per test key and one column per label, from the baseline or, with
    ``strengths``, the tuned models."""
    train = features.join(ovr_targets(features, labels.positives, key, classes), key)
    if strengths is None:
        p = score_baseline(train, test, key, classes, recipe)
    else:
        p = score_tuned(train, test, key, classes, recipe, strengths)
    return submission_wide(p, test, key, labels.names)

