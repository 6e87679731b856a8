import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from labelloom.operators import encoders as E
from labelloom.operators import moments as Mo
from labelloom.operators import pca as K


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 6)) @ rng.normal(size=(6, 6)) + 5
    x[:, 3] = 2.0  # constant column
    folds = rng.integers(0, 5, 120)
    rows = [(i, x[i].tolist(), int(folds[i])) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, x array<double>, kfold int").repartition(3)
    return df, x, folds


def stack(df, col="x"):
    return np.array([r[col] for r in df.orderBy("id").collect()])


def test_scaling_has_mean_zero_and_population_sd_one(data):
    df, x, _ = data
    z = stack(E.standard_scale(df, "x", E.scale_fit(df, "x")))
    keep = [0, 1, 2, 4, 5]
    assert np.allclose(z.mean(axis=0), 0) and np.allclose(z[:, keep].std(axis=0), 1)
    assert np.allclose(z[:, 3], 0)


def test_fold_statistics_equal_a_direct_fit(data):
    df, x, folds = data
    per_fold = Mo.fold_moments(df, "x", "kfold")
    for f in range(5):
        m = Mo.train_moments(per_fold, f)
        part = x[folds != f]
        assert m.n == len(part)
        assert np.allclose(m.mean, part.mean(axis=0)) and np.allclose(m.std(), part.std(axis=0))


def test_out_of_fold_scaling_never_uses_the_own_fold(data):
    df, x, folds = data
    z = stack(E.scale_out_of_fold(df, "x"))
    for f in range(5):
        train = x[folds != f]
        sd = train.std(axis=0)
        sd[sd == 0] = 1
        assert np.allclose(z[folds == f], (x[folds == f] - train.mean(axis=0)) / sd)


def test_one_hot_orders_numbers_as_numbers_and_rejects_new_levels(spark):
    train = spark.createDataFrame([(1, 24, "D1"), (2, 5, "D2"), (3, 48, "D1")], "id int, time int, dose string")
    levels = E.category_levels(train, ["time", "dose"])
    out = E.one_hot(train, levels)
    assert out.columns == ["time_5", "time_24", "time_48", "dose_D1", "dose_D2", "id"]
    row = out.filter("id = 2").first()
    assert (row["time_5"], row["time_24"], row["dose_D2"]) == (1, 0, 1)
    with pytest.raises(PySparkException):
        E.one_hot(spark.createDataFrame([(9, 7, "D1")], train.schema), levels).collect()


def test_integer_codes_and_unseen_levels(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "k string")
    codes = E.level_codes(train, "k")
    test = spark.createDataFrame([("c",), ("a",), ("new",)], "k string")
    got = {r["k"]: r["code"] for r in E.integer_encode(test, codes, "k", "code").collect()}
    assert got == {"c": 2, "a": 0, "new": None}


def test_count_encoding_uses_training_rows_only(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    test = spark.createDataFrame([("a",), ("z",)], "k string")
    got = {r["k"]: r["k_counts"] for r in E.count_encode(test, train, ["k"]).collect()}
    assert got == {"a": 2, "z": None}


def test_out_of_fold_counts(spark):
    rows = [("a", 0), ("a", 1), ("a", 1), ("b", 0), ("c", 2)]
    df = spark.createDataFrame(rows, "k string, kfold int")
    got = {(r["k"], r["kfold"]): r["k_counts"] for r in E.count_encode_out_of_fold(df, ["k"]).collect()}
    assert got == {("a", 0): 2, ("a", 1): 1, ("b", 0): None, ("c", 2): None}


def reference_axes(x, k):
    sd = x.std(axis=0)
    sd[sd == 0] = 1
    z = (x - x.mean(axis=0)) / sd
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    axes = vectors[:, ::-1].T[:k]
    top = np.abs(axes).argmax(axis=1)
    return z, values[::-1], axes * np.sign(axes[np.arange(k), top])[:, None]


def test_pca_matches_an_eigen_decomposition(data):
    df, x, _ = data
    z, values, axes = reference_axes(x, 2)
    fit = K.fit_pca(df, "x", 2)
    assert np.allclose(fit.values, values, atol=1e-9) and np.allclose(fit.axes, axes, atol=1e-7)
    scored = K.pca_scores(df, "x", fit, "pc").orderBy("id").collect()
    got = np.array([[r["pc1"], r["pc2"]] for r in scored])
    assert np.allclose(got, z @ axes.T, atol=1e-7)


def test_pca_per_fold_equals_a_fit_on_the_other_folds(data):
    df, x, folds = data
    fits = K.fit_pca_folds(df, "x", 2)
    for f in range(5):
        direct = K.fit_pca(df.filter(F.col("kfold") != f), "x", 2)
        assert np.allclose(fits[f].axes, direct.axes, atol=1e-7)
        assert np.allclose(fits[f].center, direct.center)


def test_pca_threshold_keeps_the_smallest_sufficient_number(data):
    df, x, _ = data
    fit = K.fit_pca(df, "x", threshold=0.95)
    shares = np.cumsum(fit.shares)
    k = len(fit.axes)
    assert shares[k - 1] >= 0.95 and (k == 1 or shares[k - 2] < 0.95)


def test_uncentred_pca_uses_raw_cross_products(data):
    df, x, _ = data
    fit = K.fit_pca(df, "x", 2, center=False, scaled=False)
    values = np.linalg.eigvalsh(x.T @ x / len(x))[::-1]
    assert np.allclose(fit.values, values)


def test_contributions_add_up(data):
    df, _, _ = data
    report = K.pca_report(df, "x", K.fit_pca(df, "x", 2))
    sums = report.groupBy("axis").agg(F.sum("contribution").alias("s")).collect()
    assert all(abs(r["s"] - 100) < 1e-9 for r in sums)


def test_corr_matrix_drops_incomplete_rows(spark):
    rows = [([1.0, 2.0],), ([2.0, 4.5],), ([3.0, 5.0],), ([None, 9.0],)]
    got = K.corr_matrix(spark.createDataFrame(rows, "x array<double>"), "x").collect()
    assert [(r["i"], r["j"]) for r in got] == [(1, 0)]
    assert np.isclose(got[0]["r"], np.corrcoef([1, 2, 3], [2, 4.5, 5])[0, 1])
