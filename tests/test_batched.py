"""Models of all classes, strengths and folds from shared passes; metrics of one score table; rows that got lost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.models import batched as B
from labelloom.models.batched import Descent
from labelloom.models.factory import fit_predict
from labelloom.models.neighbours import neighbours
from labelloom.operators import metrics as M
from labelloom.operators.density import density_grid
from labelloom.operators.encoders import one_hot
from labelloom.operators.joins import concat_by_key
from labelloom.operators.profile import describe
from labelloom.plans import recipe as Rc
from labelloom.plans import search as Se

STRENGTHS = [0.01, 1.0, 100.0]


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 6)) * [1, 2, 0.5, 1, 1, 1] + [0, 5, 0, 0, -3, 0]
    zs = [x @ rng.normal(size=6) + 2 * rng.normal(size=300) for _ in range(4)]
    ys = [(z > t).astype(int) for z, t in zip(zs, (np.median(zs[0]), np.quantile(zs[1], 0.9), 1e9, -1e9))]
    rows = [(i % 3, i, x[i].tolist(), *[int(y[i]) for y in ys]) for i in range(300)]
    df = spark.createDataFrame(rows, "kfold int, id int, x array<double>, a int, b int, none int, every int").persist()
    return df, x, ys


def newton(x, y, strength):
    ext, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([1.0 / strength] * x.shape[1] + [0.0])

    def value(w):
        z = ext @ w
        return (np.logaddexp(0, z) - y * z).sum() + 0.5 * w @ ridge @ w

    for _ in range(200):
        p = 1 / (1 + np.exp(-ext @ w))
        step = np.linalg.solve((ext * (p * (1 - p))[:, None]).T @ ext + ridge, ext.T @ (p - y) + ridge @ w)
        size = 1.0
        while value(w - size * step) > value(w) and size > 1e-10:
            size /= 2
        w = w - size * step
    return w


def other_folds(df, classes):
    parts = [df.filter(F.col("kfold") != f).select(F.lit(f).alias("part"), "x", *classes) for f in range(3)]
    return B.packed(parts[0].unionByName(parts[1]).unionByName(parts[2]), classes).persist()


@pytest.mark.parametrize("numbers", [B.CURVATURE_NUMBERS, 0])
def test_every_model_is_at_its_optimum(many, monkeypatch, numbers):
    monkeypatch.setattr(B, "CURVATURE_NUMBERS", numbers)
    df, x, ys = many
    model = B.fit_logistic(other_folds(df, ["a", "b", "none", "every"]), 4, STRENGTHS)
    for f in range(3):
        rows = np.arange(300) % 3 != f
        for c in (0, 1):
            for j, s in enumerate(STRENGTHS):
                assert np.allclose(model.weights[f][:, c * 3 + j], newton(x[rows], ys[c][rows], s), atol=2e-5)
        p = model.proba(f, x[~rows])
        assert (p[:, 6:9] == 0.0).all() and (p[:, 9:] == 1.0).all()


def test_partial_sums_in_levels(many, monkeypatch):
    df, _, _ = many
    want = B.fit_logistic(other_folds(df, ["a"]), 1, [1.0])
    monkeypatch.setattr(B, "FAN", 2)
    got = B.fit_logistic(other_folds(df.repartition(5), ["a"]), 1, [1.0])
    assert all(np.allclose(got.weights[f], want.weights[f], atol=1e-7) for f in range(3))


def test_unfinished_models_raise(many):
    with pytest.raises(RuntimeError, match="not converged"):
        B.fit_logistic(other_folds(many[0], ["a"]), 1, [1.0], passes=1)


def test_bad_features_raise(spark):
    for x in ([1.0, None], [1.0, float("nan")], None):
        df = spark.createDataFrame([(0, x, 1)], "part int, x array<double>, a int")
        with pytest.raises(Exception, match="feature"):
            B.packed(df, ["a"]).count()


def test_bayes_of_all_classes_equals_one_by_one(many):
    df, _, _ = many
    classes = ["a", "b", "none", "every"]
    model = B.fit_bayes_ovr(other_folds(df, classes), 4)
    held = df.filter("kfold = 1").withColumn("part", F.lit(1))
    got = {r["id"]: r["p"] for r in B.scored(held.select("id", "part", "x"), model).collect()}
    for i, c in enumerate(classes):
        rows = df.select("id", "kfold", "x", F.col(c).alias("y"))
        alone = fit_predict("nb", {}, rows.filter("kfold <> 1"), rows.filter("kfold = 1"), "id", 200).collect()
        assert len(alone) == 100 and all(abs(got[r["id"]][i] - r["p"]) < 1e-9 for r in alone)


def test_three_metrics_from_one_table(many):
    df, _, _ = many
    recipe = Rc.Recipe([Rc.Scale(["x"])], ["x"])
    scores = Se.out_of_fold(df, "id", ["a", "b", "none"], recipe, "log_reg", {"C": 1.0}, range(3))
    assert scores.count() == 900 and scores.columns == ["class", "fold", "id", "y", "p"]
    table = scores.toPandas()
    for r in Se.evaluated(scores, ["log_loss", "auc", "accuracy"]).collect():
        part = table[(table["class"] == r["class"]) & (table["fold"] == r["fold"])]
        y, p = part["y"].to_numpy(), part["p"].to_numpy()
        safe = np.where(p == 0, 1e-15, np.where(p == 1, 1 - 1e-15, p))
        assert np.isclose(r["log_loss"], -(y * np.log(safe) + (1 - y) * np.log(1 - safe)).mean())
        assert np.isclose(r["accuracy"], ((p > 0.5) == y).mean())
        up, down = p[y == 1][:, None], p[y == 0][None, :]
        want = ((up > down) + 0.5 * (up == down)).mean() if y.any() else None
        assert (r["auc"] is None and want is None) or np.isclose(r["auc"], want)
    with pytest.raises(ValueError):
        Se.evaluated(scores, ["f1"])
    assert Se.cv_run(df, "id", ["a"], recipe, "knn", {"n_neighbors": 4}, [0], "auc").first()["score"] > 0.5


def test_grid_search_of_all_classes_equals_single_fits(many):
    df, x, ys = many
    recipe = Rc.Recipe([], ["x"])
    grid = {"log_reg": {"penalty": ["l2"], "C": STRENGTHS}}
    found = {(r["class"], r["params"], r["fold"]): r["score"] for r in Se.grid_search(df, "id", ["a", "b"], recipe, grid, range(3)).collect()}
    assert len(found) == 18
    for i, c in enumerate("ab"):
        for s in STRENGTHS:
            for f in range(3):
                held = np.arange(300) % 3 == f
                w = newton(x[~held], ys[i][~held], s)
                z = x[held] @ w[:-1] + w[-1]
                assert np.isclose(found[c, f"penalty=l2,C={s}", f], (np.logaddexp(0, z) - ys[i][held] * z).mean(), atol=1e-6)


# ---- rows that must not get lost
@pytest.mark.parametrize("clf, params", [("rf", {"n_estimators": 3}), ("dt", {}), ("xgb", {"n_estimators": 2}), ("svm", {"C": 1.0}), ("log_reg", {"C": 1.0})])
def test_folds_without_positives_or_negatives(many, clf, params):
    df, _, _ = many
    for y, want in (("none", 0.0), ("every", 1.0)):
        rows = df.select("id", "x", F.col(y).alias("y"))
        out = fit_predict(clf, params, rows.filter("id >= 20"), rows.filter("id < 20"), "id", 280).collect()
        assert [r["p"] for r in out] == [want] * 20


def test_unmatched_keys_fail_whatever_is_selected(spark):
    left = spark.createDataFrame([(1, 10), (2, 20)], "k int, a int")
    right = spark.createDataFrame([(2, 5), (3, 7)], "k int, b int")
    for use in (lambda d: d.agg(F.sum("b")).collect(), lambda d: d.count(), lambda d: d.select("k").collect()):
        with pytest.raises(Exception, match="same keys"):
            use(concat_by_key(left, right, "k"))
    assert concat_by_key(left, right.withColumn("k", F.col("k") - 1), "k").agg(F.sum("b")).first()[0] == 12


def test_unseen_levels_fail_whatever_is_selected(spark):
    df = spark.createDataFrame([("a", 1), ("z", 2), (None, 3)], "c string, v int")
    for bad in (df, df.filter("c is null")):
        with pytest.raises(Exception, match="unknown level"):
            one_hot(bad, {"c": ["a", "b"]}).agg(F.sum("v")).collect()
    assert one_hot(df, {"c": ["a"]}, strict=False).count() == 3


def test_the_null_group_is_a_group(spark):
    rows = [(g, float(v), v % 2) for g in ("a", None) for v in range(8)]
    df = spark.createDataFrame(rows, "g string, v double, y int")
    assert {r["g"]: r["auc"] for r in M.auc(df, ["g"], "v", "y").collect()} == {"a": 0.625, None: 0.625}
    assert {r["g"]: (r["p25"], r["p50"]) for r in describe(df, ["g"], "v").collect()} == {"a": (1.75, 3.5), None: (1.75, 3.5)}
    grid = density_grid(df, ["g"], "v", 16).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in grid} == {"a": 16, None: 16}


def test_a_query_with_nan_keeps_its_neighbours(spark):
    train = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(9)], "id int, x array<double>")
    query = spark.createDataFrame([(50, [float("nan"), 1.0]), (51, [8.0, 0.0])], "id int, x array<double>")
    near = neighbours(train, query, "id", "x", 3, 2, 4).orderBy("id", "rank").collect()
    assert [(r["id"], r["neighbour"]) for r in near] == [(50, 0), (50, 1), (50, 2), (51, 8), (51, 7), (51, 6)]


def test_rounding_of_the_objective_does_not_stop_a_model():
    model = Descent(np.array([1.0 + 5e-8]), np.eye(1), np.zeros(1), 1e-8)
    for noise in (0.0, 3e-15):  # the second value is rounded up, though the gradient is 0 there
        model.told(0.3 + noise, model.trial - 1.0)
    assert model.done and model.at[0] == 1.0


def test_steep_directions_are_still_halved():
    model = Descent(np.array([3.0]), np.full((1, 1), 4.0), np.zeros(1), 1e-8)
    for _ in range(200):
        if not model.done:
            model.told(0.5 * float(model.trial @ model.trial), model.trial)
    assert model.done and abs(model.at[0]) < 1e-8
