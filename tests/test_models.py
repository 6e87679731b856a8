import warnings

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from labelloom.models.bayes import fit_bayes
from labelloom.models.factory import fit_predict
from labelloom.models.linear import fit_margin, gradient_norm, logistic
from labelloom.models.neighbours import knn_proba, neighbours
from labelloom.models.ovr import fit_ovr, predictions_long, score_ovr
from labelloom.models.trees import boosted, forest, single_tree


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 5))
    y = (x[:, 0] + 0.5 * rng.normal(size=150) > 0.3).astype(int)
    rows = [(i, x[i].tolist(), int(y[i])) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, x array<double>, y int").persist()
    return df, x, y


def vectors(df):
    return df.withColumn("features", array_to_vector("x")).withColumn("y", F.col("y").cast("double"))


@pytest.mark.parametrize("strength", [0.01, 1.0, 100.0])
def test_logistic_regression_is_at_the_optimum(data, strength):
    df, _, _ = data
    train = vectors(df)
    assert gradient_norm(train, logistic(strength, 150).fit(train), strength) < 1e-5


def test_logistic_regression_agrees_with_newton_steps(data):
    df, x, y = data
    w = np.zeros(6)
    ext = np.hstack([x, np.ones((150, 1))])
    ridge = np.diag([1.0] * 5 + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-ext @ w))
        g = ext.T @ (p - y) + ridge @ w
        h = (ext * (p * (1 - p))[:, None]).T @ ext + ridge
        w -= np.linalg.solve(h, g)
    model = logistic(1.0, 150).fit(vectors(df))
    assert np.allclose([*model.coefficients, model.intercept], w, atol=1e-4)


def test_training_rows_without_positives_give_zero(data):
    df, _, _ = data
    none = df.withColumn("y", F.lit(0))
    for clf, params in [("log_reg", {"C": 1.0}), ("nb", {}), ("knn", {"n_neighbors": 2})]:
        out = fit_predict(clf, params, none, df.limit(5), "id", 150).collect()
        assert len(out) == 5 and all(r["p"] == 0.0 for r in out), clf


def brute_neighbours(x, queries, k, p):
    out = {}
    for q in queries:
        d = (np.abs(x - x[q]) ** p).sum(axis=1)
        order = sorted((d[i], i) for i in range(len(x)) if i not in queries)
        out[q] = [i for _, i in order[:k]]
    return out


@pytest.mark.parametrize("p, block", [(2, 2048), (3, 17), (2, 40)])
def test_neighbours_match_brute_force_for_any_block_size(data, p, block):
    df, x, _ = data
    queries = set(range(0, 150, 10))
    q = F.col("id") % 10 == 0
    near = neighbours(df.filter(~q), df.filter(q), "id", "x", 4, p, block).collect()
    got = {}
    for r in sorted(near, key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got == brute_neighbours(x, queries, 4, p)


def test_equal_distances_go_to_the_smaller_key(spark):
    train = spark.createDataFrame([(i, [0.0]) for i in range(20)], "id int, x array<double>")
    query = spark.createDataFrame([(99, [1.0])], "id int, x array<double>")
    for block in (3, 100):
        near = neighbours(train, query, "id", "x", 3, 2, block).orderBy("rank").collect()
        assert [r["neighbour"] for r in near] == [0, 1, 2]


def test_knn_shares(spark):
    near = spark.createDataFrame([(9, 1, 1), (9, 2, 2)], "id int, neighbour int, rank int")
    pos = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "id int, label string")
    got = {r["class"]: r["p"] for r in knn_proba(near, pos, "id", 2).collect()}
    assert got == {"a": 1.0, "b": 0.5}


def test_naive_bayes_follows_the_formula(data):
    df, x, y = data
    model = fit_bayes(df, "x", "y")
    extra = 1e-9 * x.var(axis=0).max()
    joint = []
    for c in (0, 1):
        part = x[y == c]
        m, v = part.mean(axis=0), part.var(axis=0) + extra
        joint.append(np.log(len(part) / len(x)) - 0.5 * (np.log(2 * np.pi * v) + (x - m) ** 2 / v).sum(axis=1))
    joint = np.array(joint).T
    want = np.exp(joint - joint.max(axis=1, keepdims=True))
    want /= want.sum(axis=1, keepdims=True)
    got = np.array([r["probs"] for r in model.transform(df).orderBy("id").collect()])
    assert np.allclose(got, want, atol=1e-9)


def test_tree_parameters():
    with pytest.raises(ValueError):
        forest(10, 5, min_samples_split=100, min_samples_leaf=10)
    assert single_tree().getNumTrees() == 1 and not single_tree().getBootstrap()
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        boosted(reg_lambda=0.1)
    assert seen


@pytest.mark.parametrize(
    "clf, params",
    [
        ("rf", {"n_estimators": 5, "max_depth": 3, "min_samples_split": 2, "min_samples_leaf": 2, "max_features": "log2"}),
        ("dt", {"max_depth": 3, "min_samples_split": 2, "min_samples_leaf": 2, "max_features": "log2"}),
        ("xgb", {"eta": 0.1, "max_depth": 2, "n_estimators": 3}),
        ("svm", {"C": 1.0, "class_weight": "balanced"}),
        ("log_reg", {"C": 1.0}),
        ("knn", {"n_neighbors": 4, "p": 2}),
        ("nb", {"dummy_param": None}),
    ],
)
def test_every_classifier_separates_the_classes(data, clf, params):
    df, _, _ = data
    train, valid = df.filter("id >= 50"), df.filter("id < 50")
    out = fit_predict(clf, params, train, valid, "id", 100).toPandas()
    assert len(out) == 50 and out["p"].between(0, 1).all()
    assert out[out["y"] == 1]["p"].mean() > out[out["y"] == 0]["p"].mean() + 0.1


def test_one_pass_scoring_equals_each_model(data):
    df, _, _ = data
    train = vectors(df).withColumns({"a": F.col("y"), "b": 1 - F.col("y")})
    model = fit_ovr(train, ["a", "b"], [1.0, 0.1])
    scored = score_ovr(train.select("id", "features"), model)
    models = [logistic(s, 150, tol=1e-12).fit(train.withColumn("y", F.col(c))) for c, s in (("a", 1.0), ("b", 0.1))]
    got = {r["id"]: r["probs"] for r in scored.collect()}
    for i, m in enumerate(models):
        alone = m.transform(train).select("id", vector_to_array("probability")[1].alias("p")).collect()
        assert all(abs(got[r["id"]][i] - r["p"]) < 1e-5 for r in alone)
    long = predictions_long(scored, "id", ["a", "b"])
    assert long.count() == 300 and set(long.columns) == {"id", "label", "p"}


def test_margin_model_is_deterministic(data):
    df, _, _ = data
    train = vectors(df)
    runs = [
        [r[0] for r in fit_margin(train, 1.0, 150, 5, width=32).transform(train).orderBy("id")
         .select(vector_to_array("probability")[1]).collect()]
        for _ in range(2)
    ]
    assert np.allclose(runs[0], runs[1])
