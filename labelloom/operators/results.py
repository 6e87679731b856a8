"""Result tables of searches and runs."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.models.trees import allowed_depth
from labelloom.operators.joins import frozen_if_small
from labelloom.roles import HIDDEN
from labelloom.session import settle

# fixed values: classifier names a grid may use
CLASSIFIERS = ("log_reg", "svm", "rf", "dt", "knn", "nb", "xgb")


def validate_grid(grid: Mapping[str, Mapping[str, Sequence]]) -> None:
    """Reject unknown classifiers and impossible values before any job starts."""
    for clf, params in grid.items():
        if clf not in CLASSIFIERS:
            raise ValueError(f"unknown classifier {clf!r}")
        splits, leaves = params.get("min_samples_split", []), params.get("min_samples_leaf", [1])
        for s in splits:
            if s < 2:
                raise ValueError(f"{clf}: min_samples_split must be at least 2, got {s}")
            if any(s > 2 * leaf for leaf in leaves):
                raise ValueError(f"{clf}: min_samples_split {s} is not implied by min_samples_leaf")
        for depth in params.get("max_depth", []):
            allowed_depth(depth)


def combinations(grid: Mapping[str, Mapping[str, Sequence]]) -> list[tuple[str, int, dict]]:
    """(classifier, ordinal, params) in key order, last parameter fastest."""
    out = []
    for clf, params in grid.items():
        for i, values in enumerate(itertools.product(*params.values())):
            out.append((clf, i, dict(zip(params, values))))
    return out


def param_grid(classes: DataFrame, grid: Mapping[str, Mapping[str, Sequence]]) -> DataFrame:
    """Search space: every class with every combination, (class, clf, ordinal, params).

    Each parameter list is exploded in turn, so a grid of hundreds of thousands
    of combinations is generated by the executors and not written into the plan.
    The class list is computed once for all classifiers.
    """
    small = frozen_if_small(classes)
    classes = settle(classes) if small is None else small
    parts = []
    for clf, params in grid.items():
        rows = classes.select(
            "class",
            F.lit(clf).alias("clf"),
            F.lit(0).alias("ordinal"),
            F.lit(None).cast("string").alias("params"),
        )
        for name, values in params.items():
            texts = F.array(*[F.lit(params_text({name: v})) for v in values])
            rows = rows.select("*", F.posexplode(texts).alias("__i", "__t")).select(
                "class",
                "clf",
                (F.col("ordinal") * len(values) + F.col("__i")).alias("ordinal"),
                F.concat_ws(",", "params", "__t").alias("params"),
            )
        parts.append(rows)
    return reduce(DataFrame.unionByName, parts)


def params_text(params: Mapping) -> str:
    return ",".join(f"{k}={v}" for k, v in params.items())


def fold_mean(scores: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    return scores.groupBy(*by).agg(F.avg(score).alias("mean_score"))


def best_params(means: DataFrame) -> DataFrame:
    """Per (class, clf) the combination with the lowest mean, first in grid order on ties."""
    rank = F.struct("mean_score", "ordinal")
    return means.groupBy("class", "clf").agg(
        F.min_by("params", rank).alias("params"), F.min("mean_score").alias("mean_score")
    )


def best_classifier(best: DataFrame, compat: bool = False) -> DataFrame:
    """Per class the classifier with the lowest score (name order on ties).

    ``compat`` gives every class the winner of the hidden class.
    """
    rank = F.struct("mean_score", "clf")
    winner = F.min_by(F.struct("clf", "params", "mean_score"), rank).alias("w")
    if not compat:
        return best.groupBy("class").agg(winner).select("class", "w.*")
    hidden = best.filter(F.col("class") == HIDDEN).agg(winner).select("w").scalar()
    return best.select("class").distinct().withColumn("w", hidden).select("class", "w.*")


def align_runs(runs: DataFrame, names: Sequence[str]) -> DataFrame:
    """(run, class, score) to one row per class with a column per run and the
    difference of every run to the first."""
    wide = runs.groupBy("class").pivot("run", list(names)).agg(F.first("score"))
    base = F.col(names[0])
    return wide.withColumns({f"{n}_diff": F.col(n) - base for n in names[1:]})


def compare_runs(runs: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per later run: classes improved against the first run, and classes compared."""
    wide = align_runs(runs, names)
    long = wide.unpivot("class", [f"{n}_diff" for n in names[1:]], "run", "diff")
    return long.groupBy(F.regexp_replace("run", "_diff$", "").alias("run")).agg(
        F.sum((F.col("diff") < 0).cast("bigint")).alias("improved"),
        F.count("diff").alias("classes"),
        F.avg("diff").alias("mean_diff"),
    )


def result_cell(penalty: Column, strength: Column, score: Column) -> Column:
    """Text form of one best-parameter cell, e.g. ``[('l2', 0.1), 0.02]``."""
    return F.concat(
        F.lit("[('"), penalty, F.lit("', "), strength.cast("string"), F.lit("), "), score.cast("string"), F.lit("]")
    )


def tuned_strength(cell: Column) -> Column:
    """Second parameter of a best-parameter cell."""
    return F.regexp_extract(cell, r", ([0-9.eE+-]+)\)", 1).cast("double")
