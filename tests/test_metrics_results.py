import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.functions.binomial import beta_quantile, beta_share
from labelloom.operators import metrics as M
from labelloom.operators import profile as P
from labelloom.operators import results as R
from labelloom.operators.density import density_grid
from labelloom.roles import HIDDEN


def numpy_loss(y, p):
    p = np.where(p == 0, 1e-15, np.where(p == 1, 1 - 1e-15, p))
    return -(y * np.log(p) + (1 - y) * np.log(1 - p))


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.random((40, 3)), 1)
    p[0] = [0.0, 1.0, 1e-16]
    y = rng.integers(0, 2, (40, 3))
    cells = [(i, f"l{j}", int(y[i, j]), float(p[i, j])) for i in range(40) for j in range(3)]
    return spark.createDataFrame(cells, "id int, label string, y int, p double"), y, p


def test_only_exact_zero_and_one_are_replaced(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 1.0), (1, 1e-16), (0, 0.5)], "y int, p double")
    got = [r[0] for r in df.select(M.cell_loss(F.col("y"), F.col("p"))).collect()]
    want = [-math.log(1e-15), -math.log(1 - (1 - 1e-15)), -math.log(1e-16), -math.log(0.5)]
    assert np.allclose(got, want)


def test_class_log_loss(scores):
    df, y, p = scores
    got = {r["label"]: r["log_loss"] for r in M.class_log_loss(df, ["label"]).collect()}
    for j in range(3):
        assert np.isclose(got[f"l{j}"], numpy_loss(y[:, j], p[:, j]).mean())


def test_raw_loss_is_infinite_or_skips_undefined_cells(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 1, 0.5), ("b", 0, 0.0), ("b", 1, 0.5)], "k string, y int, p double")
    got = {r["k"]: r["log_loss"] for r in M.class_log_loss(df, ["k"], eps=None).collect()}
    assert got["a"] == float("inf") and np.isclose(got["b"], math.log(2))


def test_sparse_multilabel_loss_equals_the_dense_mean(scores):
    df, y, p = scores
    sparse = df.filter("p > 0").select("id", "label", "p")
    positives = df.filter("y = 1").select("id", "label")
    got = M.multilabel_log_loss(sparse, positives, "id", 40, 3).first()[0]
    assert np.isclose(got, numpy_loss(y, p).mean(axis=0).mean(), rtol=1e-12)


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def test_auc_counts_ties_half_and_is_rank_based(scores):
    df, y, p = scores
    got = {r["label"]: r["auc"] for r in M.auc(df, ["label"], "p", "y").collect()}
    moved = {r["label"]: r["auc"] for r in M.auc(df.withColumn("p", 3 * F.col("p")), ["label"], "p", "y").collect()}
    for j in range(3):
        assert np.isclose(got[f"l{j}"], brute_auc(y[:, j], p[:, j]))
        assert np.isclose(got[f"l{j}"], moved[f"l{j}"])


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, p double")
    assert M.auc(df, [], "p", "y").first()["auc"] is None


def test_log_loss_of_a_class_the_model_does_not_know(spark):
    df = spark.createDataFrame([("a", [0.8, 0.2]), ("z", [0.5, 0.5])], "y string, p array<double>")
    got = M.log_loss_with_labels(df, "p", "y", ["a", "b"]).first()[0]
    assert np.isclose(got, (-math.log(0.8) - math.log(1e-15)) / 2)


def test_accuracy(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (1, 1), (0, 0)], "y int, q int")
    assert M.accuracy(df, [], "y", "q").first()["accuracy"] == 0.75


def means(spark):
    rows = [
        ("a", "nb", 0, "x=1", 0.2),
        ("a", "rf", 0, "d=1", 0.2),
        ("a", "rf", 1, "d=2", 0.2),
        (HIDDEN, "nb", 0, "x=1", 0.9),
        (HIDDEN, "rf", 0, "d=1", 0.5),
        (HIDDEN, "rf", 1, "d=2", 0.4),
    ]
    return spark.createDataFrame(rows, "class string, clf string, ordinal int, params string, mean_score double")


def test_best_parameters_take_the_first_of_equal_scores(spark):
    best = {(r["class"], r["clf"]): r["params"] for r in R.best_params(means(spark)).collect()}
    assert best[("a", "rf")] == "d=1" and best[(HIDDEN, "rf")] == "d=2"


def test_best_classifier_per_class_or_from_the_hidden_class(spark):
    best = R.best_params(means(spark))
    own = {r["class"]: r["clf"] for r in R.best_classifier(best).collect()}
    assert own == {"a": "nb", HIDDEN: "rf"}
    compat = {r["class"]: (r["clf"], r["params"]) for r in R.best_classifier(best, compat=True).collect()}
    assert compat == {"a": ("rf", "d=2"), HIDDEN: ("rf", "d=2")}


def test_grid_order_and_validation():
    grid = {"knn": {"n_neighbors": [2, 4], "p": [2, 3]}, "nb": {"dummy_param": [None]}}
    assert [(c, i, tuple(p.values())) for c, i, p in R.combinations(grid)] == [
        ("knn", 0, (2, 2)),
        ("knn", 1, (2, 3)),
        ("knn", 2, (4, 2)),
        ("knn", 3, (4, 3)),
        ("nb", 0, (None,)),
    ]
    with pytest.raises(ValueError):
        R.validate_grid({"df": {"max_depth": [5]}})
    with pytest.raises(ValueError):
        R.validate_grid({"rf": {"min_samples_split": [1], "min_samples_leaf": [1]}})
    with pytest.raises(ValueError):
        R.validate_grid({"rf": {"min_samples_split": [100], "min_samples_leaf": [10]}})


def test_the_large_grid_has_the_expected_size():
    sizes = [5, 7, 8, 4, 5, 5, 3, 4]
    grid = {"xgb": {f"p{i}": list(range(n)) for i, n in enumerate(sizes)}}
    assert len(R.combinations(grid)) == 336_000


def test_search_space_is_generated_in_grid_order(spark):
    classes = spark.createDataFrame([("a",), ("b",)], "class string")
    sizes = [5, 7, 8, 4, 5, 5, 3, 4]
    large = {"xgb": {f"p{i}": list(range(n)) for i, n in enumerate(sizes)}}
    space = R.param_grid(classes, large)
    assert space.count() == 2 * 336_000 and space.select("ordinal").distinct().count() == 336_000
    small = {"knn": {"n_neighbors": [2, 4], "p": [2, 3]}, "nb": {"dummy_param": [None]}}
    got = sorted((r["clf"], r["ordinal"], r["params"]) for r in R.param_grid(classes, small).collect() if r["class"] == "a")
    assert got == sorted((c, i, R.params_text(p)) for c, i, p in R.combinations(small))


def test_text_cells_are_parsed(spark):
    cells = ["[('l2', 0.001), 0.57]", "[('l2', 100), 0.02]", "[('l2', 1e-05), 0.1]"]
    df = spark.createDataFrame([(c,) for c in cells], "cell string")
    assert [r[0] for r in df.select(R.tuned_strength(F.col("cell"))).collect()] == [0.001, 100.0, 1e-5]


def test_compare_runs(spark):
    rows = [("base", "a", 1.0), ("base", "b", 1.0), ("fe", "a", 0.5), ("fe", "b", 1.5)]
    df = spark.createDataFrame(rows, "run string, class string, score double")
    got = R.compare_runs(df, ["base", "fe"]).first()
    assert (got["run"], got["improved"], got["classes"], got["mean_diff"]) == ("fe", 1, 2, 0.0)


def test_binomial_bounds(spark):
    assert np.isclose(beta_share(2, 3, 0.4), 0.5248)
    assert np.isclose(beta_quantile(0.5, 1, 1), 0.5)
    rows = [("a", 1 if i < 3 else 0) for i in range(10)] + [("z", 0)] * 5
    out = P.proportion_ci(spark.createDataFrame(rows, "k string, y int"), ["k"], "y")
    got = {r["k"]: (r["lwr"], r["upr"]) for r in out.collect()}
    assert np.allclose(got["a"], (0.0667395, 0.6524529), atol=1e-6)
    assert got["z"][0] == 0.0 and np.isclose(got["z"][1], 1 - 0.025 ** (1 / 5))


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.normal(size=400)] + [("b", float(v)) for v in rng.random(200)]
    out = density_grid(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", 256).toPandas()
    for _, part in out.sort_values("x").groupby("g"):
        area = np.trapezoid(part["density"], part["x"])
        assert abs(area - 1) < 0.01


def test_null_count_wide_and_packed(spark):
    wide = spark.range(3).selectExpr(*[f"if(id = {i % 4}, null, id) as c{i}" for i in range(876)])
    assert P.null_count(wide).first()[0] == 876 * 3 // 4
    packed = spark.createDataFrame([([1.0, None, None],), (None,), ([],)], "v array<double>")
    assert P.null_count(packed).first()[0] == 3


def test_profile_counts(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), (None, 3)], "k string, v int")
    assert P.null_count(df).first()[0] == 1
    assert P.duplicate_keys(df, "v").first()[0] == 1
    share = {r["k"]: r["perc"] for r in P.count_share(df.filter("k is not null"), "k").collect()}
    assert share == {"x": 2 / 3, "y": 1 / 3}
    band = P.count_band(df.filter("k is not null"), "k", None, 2)
    assert [r["k"] for r in band.collect()] == ["y"]


def test_conformance(spark):
    a = spark.createDataFrame([(1, 0.0), (2, 0.0)], "k int, p double")
    same = P.conformance_check(a, a, "k").first()
    assert tuple(same) == (True, True, True)
    other = P.conformance_check(a.filter("k = 1").withColumnRenamed("p", "q"), a, "k").first()
    assert tuple(other) == (False, False, False)


def test_constant_columns_are_counted(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([2.0, 5.0],)], "x array<double>")
    row = P.constant_check(df, "x").first()
    assert row["min_sd"] == 0.0 and row["constant_columns"] == 1
