"""Cross-validation and search over classes, classifiers, parameters and folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.rowstats import keep_argmax
from labelloom.models.batched import Linear, fit_bayes_ovr, fit_logistic, packed, scored
from labelloom.models.factory import fit_predict
from labelloom.models.neighbours import neighbours
from labelloom.models.ovr import WORKERS, in_pool, predictions_long
from labelloom.operators.metrics import auc, cell_loss, class_log_loss, multilabel_log_loss
from labelloom.operators.results import combinations, fold_mean, params_text, validate_grid
from labelloom.plans.recipe import Recipe
from labelloom.roles import HIDDEN, named
from labelloom.session import settle

RESULT_SCHEMA = "class string, clf string, ordinal int, params string, fold int, score double"


@contextmanager
def _persisted(df: DataFrame):
    """Keep ``df`` for the duration of a search, unless the caller already does."""
    own = df.storageLevel == StorageLevel.NONE
    if own:
        df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        if own:
            df.unpersist()


def grid_search(
    df: DataFrame,
    key: str,
    classes: Sequence[str],
    recipe: Recipe,
    grid: Mapping[str, Mapping[str, Sequence]],
    folds: Sequence[int] = range(5),
    done: DataFrame | None = None,
    workers: int = WORKERS,
    folds_at_once: int = 2,
    results_path: str | None = None,
) -> DataFrame:
    """Class log-loss of every class x classifier x combination x fold.

    ``df`` holds the key, ``kfold``, the raw features and one 0/1 column per
    class. The features of a fold are computed once and shared by all its fits,
    which run from a small pool; ``folds_at_once`` bounds how many copies of
    the matrix are kept. Combinations present in ``done`` are skipped and every
    finished group of folds is added to ``results_path``, so an interrupted
    search can go on from there.
    """
    validate_grid(grid)
    spark, folds = df.sparkSession, list(folds)
    earlier = []
    if done is not None:
        earlier = [tuple(r) for r in done.select(*RESULT_COLUMNS).collect()]  # result rows only
    known = {(r[0], r[1], r[3], r[4]) for r in earlier}
    out = list(earlier)
    first, recipe = recipe.leading()  # what all folds share is computed once
    with _persisted(first.fit(df).transform(df)) as df:
        sizes = {r["kfold"]: r["count"] for r in df.groupBy("kfold").count().collect()}
        n = sum(sizes.values())
        fitted = recipe.fit_folds(df, folds)
        for at in range(0, len(folds), folds_at_once):
            frames, tasks, together = {}, [], []
            for f in folds[at : at + folds_at_once]:
                frame = recipe.matrix(fitted[f].transform(df), [key, "kfold", *classes])
                frames[f] = frame.persist(StorageLevel.MEMORY_AND_DISK)
                todo = [
                    (clf, ordinal, params, c)
                    for clf, ordinal, params in combinations(grid)
                    for c in classes
                    if (c, clf, params_text(params), f) not in known
                ]
                together += [(*t, f) for t in todo if t[0] in TOGETHER]
                todo = [t for t in todo if t[0] not in TOGETHER]
                near = [t for t in todo if t[0] == "knn"]
                for p in {t[2].get("p", 2) for t in near}:
                    group = [t for t in near if t[2].get("p", 2) == p]
                    tasks.append(_neighbour_task(frame, key, group, p, f))
                for clf, ordinal, params, c in todo:
                    if clf != "knn":
                        n_train = n - sizes.get(f, 0)
                        tasks.append(_fold_task(frame, key, c, clf, ordinal, params, f, n_train))
            for clf in TOGETHER:
                if group := [t for t in together if t[0] == clf]:
                    views = recipe.views(df, {f: fitted[f] for f in frames}) if clf == "log_reg" else None
                    tasks.insert(0, _together_task(frames, key, classes, clf, group, views))
            found = [row for rows in in_pool(spark, tasks, workers) for row in rows]
            if results_path and found:
                spark.createDataFrame(found, RESULT_SCHEMA).write.mode("append").parquet(results_path)
            out += found
            for frame in frames.values():
                frame.unpersist()
    return spark.createDataFrame(out, RESULT_SCHEMA)


RESULT_COLUMNS = ("class", "clf", "ordinal", "params", "fold", "score")


TOGETHER = ("log_reg", "nb")  # fitted for all classes, parameters and folds by the same passes


def _fitted_together(
    frames: Mapping[int, DataFrame], classes: Sequence[str], clf: str, strengths: Sequence[float],
    views: Mapping[int, np.ndarray] | None = None,
):
    """One model of every fold (``part``), class and strength; fold f is trained on the other rows of ``frames[f]``.

    With ``views`` (see ``Recipe.views``) the rows of the first frame serve the linear models of all folds.
    """
    if clf == "log_reg" and views is not None:
        rows = next(iter(frames.values())).filter(F.col("kfold").isNotNull())
        rows = rows.select(F.col("kfold").alias("part"), "x", *[named(c) for c in classes])
        blocks = packed(rows, classes).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return fit_logistic(blocks, len(classes), strengths, views=views)
        finally:
            blocks.unpersist()
    parts = [
        d.filter(F.col("kfold") != f).select(F.lit(f).alias("part"), "x", *[named(c) for c in classes])
        for f, d in frames.items()
    ]
    blocks = packed(reduce(DataFrame.unionByName, parts), classes).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return fit_bayes_ovr(blocks, len(classes)) if clf == "nb" else fit_logistic(blocks, len(classes), strengths)
    finally:
        blocks.unpersist()


def _held_out(
    frames: Mapping[int, DataFrame], key: str, classes: Sequence[str], model, views: Mapping[int, np.ndarray] | None = None
) -> DataFrame:
    """(part, key, y, p) of the held-out rows, y with an entry per class and p per class and strength."""
    if views is not None:  # the rows of the first frame, and weights for them
        weights = {}
        for f, w in model.weights.items():
            weights[f], sure = views[f] @ np.where(np.isinf(w), 0.0, w), np.isinf(w[-1])
            weights[f][:, sure] = w[:, sure]
        model = Linear(weights)
        rows = next(iter(frames.values())).filter(F.col("kfold").isin(list(frames)))
        y = F.array(*[named(c).cast("int") for c in classes]).alias("y")
        return scored(rows.select(F.col("kfold").cast("int").alias("part"), key, "x", y), model)
    parts = [
        d.filter(F.col("kfold") == f).select(
            F.lit(f).alias("part"), key, "x", F.array(*[named(c).cast("int") for c in classes]).alias("y")
        )
        for f, d in frames.items()
    ]
    return scored(reduce(DataFrame.unionByName, parts), model)


def _scored_together(frames: Mapping[int, DataFrame], key: str, classes: Sequence[str], model) -> DataFrame:
    """(fold, key, at, y, p) of the held-out rows, ``at`` counting classes and within them strengths."""
    out = _held_out(frames, key, classes, model)
    out = out.select(F.col("part").alias("fold"), key, "y", F.posexplode("p").alias("at", "p"))
    width = len(next(iter(model.weights.values()))[0]) // len(classes) if isinstance(model, Linear) else 1
    return out.select("fold", key, "at", F.get("y", F.floor(F.col("at") / width).cast("int")).alias("y"), "p")


def _together_task(frames, key, classes, clf, todo, views=None):
    strengths = sorted({params["C"] for _, _, params, _, _ in todo}) if clf == "log_reg" else [None]

    def run():
        model = _fitted_together(frames, classes, clf, strengths, views)
        cells = _scored_together(frames, key, classes, model)
        losses = class_log_loss(cells, ["fold", "at"]).collect()  # result rows only
        loss = {(r["fold"], r["at"]): r["log_loss"] for r in losses}
        return [
            (
                c, clf, ordinal, params_text(params), int(f),
                loss.get((f, classes.index(c) * len(strengths) + strengths.index(params.get("C")))),
            )
            for _, ordinal, params, c, f in todo
        ]

    return run


def _fold_task(frame, key, c, clf, ordinal, params, fold, n_train):
    rows = frame.select(key, "kfold", "x", named(c).alias("y"))
    train, valid = rows.filter(F.col("kfold") != fold), rows.filter(F.col("kfold") == fold)

    def run():
        scored = fit_predict(clf, params, train, valid, key, n_train)
        score = class_log_loss(scored, []).first()["log_loss"]
        return [(c, clf, ordinal, params_text(params), int(fold), score)]

    return run


def _neighbour_task(frame, key, todo, p, fold):
    """All neighbour counts and classes of one fold from a single search."""
    train, valid = frame.filter(F.col("kfold") != fold), frame.filter(F.col("kfold") == fold)
    classes = sorted({c for _, _, _, c in todo})
    sizes = sorted({params["n_neighbors"] for _, _, params, _ in todo})

    def run():
        near = neighbours(train, valid, key, "x", max(sizes), p)
        held = train.select(F.col(key).alias("neighbour"), *[named(c) for c in classes])
        votes = near.join(held, "neighbour").groupBy(key).agg(
            *[
                (F.sum(F.when(F.col("rank") <= k, named(c))) / k).alias(f"p{k}_{i}")
                for k in sizes
                for i, c in enumerate(classes)
            ]
        )
        scored = votes.join(valid.select(key, *[named(c) for c in classes]), key)
        losses = scored.agg(
            *[
                F.avg(cell_loss(named(c), F.col(f"p{k}_{i}"))).alias(f"p{k}_{i}")
                for k in sizes
                for i, c in enumerate(classes)
            ]
        ).first()
        at = {c: i for i, c in enumerate(classes)}
        return [
            (c, clf, o, params_text(ps), int(fold), losses[f"p{ps['n_neighbors']}_{at[c]}"])
            for clf, o, ps, c in todo
        ]

    return run


def out_of_fold(
    df: DataFrame, key: str, classes: Sequence[str], recipe: Recipe, clf: str, params: Mapping,
    folds: Sequence[int] = range(5), wide: bool = False,
) -> DataFrame:
    """(class, fold, key, y, p): every row's probability from the model that has not seen its fold.

    Written once to the shared folder, so any metric is an aggregation of it.
    With ``wide`` one row per key, y and p as arrays in the order of the
    classes: (fold, key, y, p), for linear models and naive Bayes.
    """
    if wide and clf not in TOGETHER:
        raise ValueError(f"only {TOGETHER} give all classes of a row at once, got {clf}")
    validate_grid({clf: {k: [v] for k, v in params.items()}})
    folds, classes = list(folds), list(classes)
    first, recipe = recipe.leading()
    with _persisted(first.fit(df).transform(df)) as df:
        fitted = recipe.fit_folds(df, folds)
        frames = {f: recipe.matrix(fitted[f].transform(df), [key, "kfold", *classes]) for f in folds}
        if clf in TOGETHER:
            views = recipe.views(df, fitted) if clf == "log_reg" else None
            model = _fitted_together(frames, classes, clf, [params.get("C")], views)
            found = settle(_held_out(frames, key, classes, model, views).withColumnRenamed("part", "fold"))
            return found if wide else _by_class(found, classes)
        sizes = {r["kfold"]: r["count"] for r in df.groupBy("kfold").count().collect()}
        tasks = [
            _written_scores(frames[f], key, c, clf, params, f, sum(sizes.values()) - sizes.get(f, 0))
            for f in folds for c in classes
        ]
        return reduce(DataFrame.unionByName, in_pool(df.sparkSession, tasks))


def _by_class(found: DataFrame, classes: Sequence[str]) -> DataFrame:
    """The rows of a wide score table, one per class."""
    names = F.array(*[F.lit(c) for c in classes])
    key = next(c for c in found.columns if c not in ("fold", "y", "p"))
    cells = found.select("fold", key, F.posexplode(F.arrays_zip("y", "p")).alias("at", "cell"))
    return cells.select(F.get(names, F.col("at")).alias("class"), "fold", key, "cell.y", "cell.p")


def _written_scores(frame, key, c, clf, params, fold, n_train):
    rows = frame.select(key, "kfold", "x", named(c).alias("y"))
    train, valid = rows.filter(F.col("kfold") != fold), rows.filter(F.col("kfold") == fold)

    def run():
        found = fit_predict(clf, params, train, valid, key, n_train)
        return settle(found.select(F.lit(c).alias("class"), F.lit(fold).alias("fold"), key, F.col("y").cast("int"), "p"))

    return run


def evaluated(
    scores: DataFrame, metrics: Sequence[str] = ("log_loss",), by: Sequence[str] = ("class", "fold"),
    classes: Sequence[str] | None = None,
) -> DataFrame:
    """(by..., a column per metric) of a score table with y and p; a wide one if its ``classes`` are given.

    ``log_loss``, ``accuracy`` (p beyond one half) and ``auc``; an AUC without
    both classes is null, as no pair of rows can be ranked.
    """
    if not metrics or (unknown := set(metrics) - set(METRICS)):
        raise ValueError(f"metrics are some of {METRICS}, got {sorted(unknown) if metrics else 'none'}")
    plain = {
        "log_loss": F.avg(cell_loss(F.col("y"), F.col("p"))).alias("log_loss"),
        "accuracy": F.avg(((F.col("p") > 0.5).cast("int") == F.col("y")).cast("int")).alias("accuracy"),
    }
    cells = scores if classes is None else _by_class(scores, classes)
    out = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), *[plain[m] for m in metrics if m in plain])
    if "auc" in metrics:
        areas = auc(scores, by, "p", "y", classes).withColumnsRenamed({b: f"__{b}" for b in by})
        same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by])
        out = out.join(areas, same, "left")
    return out.select(*by, *metrics)


METRICS = ("log_loss", "auc", "accuracy")


def cv_run(
    df: DataFrame, key: str, classes: Sequence[str], recipe: Recipe, clf: str, params: Mapping,
    folds: Sequence[int] = range(5), metric: str = "log_loss",
) -> DataFrame:
    """One classifier and one parameter set over all folds: (class, fold, score)."""
    wide = clf in TOGETHER
    scores = out_of_fold(df, key, classes, recipe, clf, params, folds, wide)
    found = evaluated(scores, [metric], classes=list(classes) if wide else None)
    return found.withColumnRenamed(metric, "score")


def multilabel_cv(
    df: DataFrame,
    key: str,
    classes: Sequence[str],
    positives: DataFrame,
    n_labels: int,
    recipe: Recipe,
    strength: float | Mapping[str, float] = 1.0,
    folds: Sequence[int] = range(5),
) -> DataFrame:
    """(fold, score): all classes fitted one-vs-rest (``strength``: for all, or per class), the row maximum kept,
    the hidden class dropped, then the multilabel log-loss over all labels."""
    first, recipe = recipe.leading()
    folds, classes = list(folds), list(classes)
    given = [[strength[c] if isinstance(strength, Mapping) else strength] for c in classes]
    with _persisted(first.fit(df).transform(df)) as df:
        fitted = recipe.fit_folds(df, folds)
        frames = {f: recipe.matrix(fitted[f].transform(df), [key, "kfold", *classes]) for f in folds}
        model = _fitted_together(frames, classes, "log_reg", given, recipe.views(df, fitted))
        held = [d.filter(F.col("kfold") == f).select(F.lit(f).alias("part"), key, "x") for f, d in frames.items()]
        probs = settle(scored(reduce(DataFrame.unionByName, held), model, "probs"))
        kept = probs.withColumn("probs", keep_argmax(F.col("probs")))
        p = predictions_long(kept, key, classes).filter(F.col("label") != HIDDEN)
        out = []
        for f in folds:
            rows = probs.filter(F.col("part") == f).select(key)
            truth = positives.join(rows, key, "left_semi")
            loss = multilabel_log_loss(p.join(rows, key, "left_semi"), truth, key, rows.count(), n_labels)
            out.append((int(f), loss.first()["log_loss"]))
    return df.sparkSession.createDataFrame(out, "fold int, score double")


def greedy_feature_sets(
    df: DataFrame,
    key: str,
    classes: Sequence[str],
    candidates: Sequence[tuple[str, Recipe]],
    clf: str,
    params: Mapping,
    folds: Sequence[int] = range(5),
) -> DataFrame:
    """Try feature sets in order, keep one when it lowers the mean score:
    (step, name, mean_score, kept)."""
    spark: SparkSession = df.sparkSession
    best, rows = float("inf"), []
    with _persisted(df):
        for i, (name, recipe) in enumerate(candidates):
            scores = cv_run(df, key, classes, recipe, clf, params, folds)
            mean = fold_mean(scores, []).first()["mean_score"]
            kept = mean < best
            best = min(best, mean)
            rows.append((i, name, mean, kept))
    return spark.createDataFrame(rows, "step int, name string, mean_score double, kept boolean")
