import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from labelloom import session
from labelloom.models.linear import logistic
from labelloom.operators import targets as T
from labelloom.operators.splits import stratified_kfold
from labelloom.plans import recipe as Rc
from labelloom.plans import scoring as Sc
from labelloom.plans import search as Se
from labelloom.roles import HIDDEN
from labelloom.sources import sinks, tables


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(100, 4))
    kinds = rng.choice(["u", "v", "w"], 100)
    rows = [
        (i, str(kinds[i]), x[i].tolist(), float(x[i, 0] * 3 + 1), int(x[i, 0] > 0), int(x[i, 1] > 0.8))
        for i in range(100)
    ]
    df = spark.createDataFrame(rows, "id int, kind string, g array<double>, s double, a int, b int")
    folds = stratified_kfold(df.withColumn("t", F.col("a").cast("string")), "id", "t")
    return df.join(folds.select("id", "kfold"), "id").persist()


FULL = Rc.Recipe(
    [
        Rc.RowStats(["g"], ["min", "mean"]),
        Rc.OneHot(["kind"]),
        Rc.CountEncode(["kind"]),
        Rc.Pca(["g"], 2),
        Rc.Scale(["g", "stats", "pcg"], scalars=["s", "kind_counts"]),
    ],
    ["onehot", "g", "stats", "pcg", "scalars"],
)


def matrix(recipe, fitted, df):
    rows = recipe.matrix(fitted.transform(df), ["id"]).orderBy("id").collect()
    return np.array([r["x"] for r in rows])


def test_recipe_width_and_scaling(data):
    x = matrix(FULL, FULL.fit(data), data)
    assert x.shape == (100, 3 + 4 + 2 + 2 + 2)
    assert np.allclose(x[:, 3:].mean(axis=0), 0) and np.allclose(x[:, 3:12].std(axis=0), 1)


def test_fold_recipes_equal_fits_on_the_training_rows(data):
    by_fold = FULL.fit_folds(data, range(5))
    simple = Rc.Recipe([Rc.OneHot(["kind"]), Rc.Scale(["g"], scalars=["s"])], ["onehot", "g", "scalars"])
    simple_folds = simple.fit_folds(data, range(5))
    for f in (0, 3):
        train = data.filter(F.col("kfold") != f)
        for recipe, fits in ((FULL, by_fold), (simple, simple_folds)):
            assert np.allclose(matrix(recipe, fits[f], data), matrix(recipe, recipe.fit(train), data), atol=1e-8)


def test_validation_rows_do_not_change_a_fit(data):
    changed = data.withColumn("g", F.when(F.col("kfold") == 1, F.transform("g", lambda v: v * 50)).otherwise(F.col("g")))
    a, b = (FULL.fit_folds(d, [1])[1] for d in (data, changed))
    train = data.filter("kfold <> 1")
    assert np.allclose(matrix(FULL, a, train), matrix(FULL, b, train), atol=1e-8)


SIMPLE = Rc.Recipe([Rc.OneHot(["kind"]), Rc.Scale(["g"])], ["onehot", "g"])


def test_grid_search_and_resuming(data, spark):
    grid = {"log_reg": {"penalty": ["l2"], "C": [0.1, 1.0]}, "nb": {"dummy_param": [None]}}
    whole = Se.grid_search(data, "id", ["a", "b"], SIMPLE, grid, folds=[0, 1])
    rows = {tuple(r)[:2] + (r["params"], r["fold"]): r["score"] for r in whole.collect()}
    assert len(rows) == 3 * 2 * 2 and all(0 < s < 5 for s in rows.values())
    marked = whole.filter("clf = 'nb'").withColumn("score", F.lit(-1.0))
    again = Se.grid_search(data, "id", ["a", "b"], SIMPLE, grid, folds=[0, 1], done=marked)
    kept = [r["score"] for r in again.filter("clf = 'nb'").collect()]
    assert kept == [-1.0] * 4 and again.count() == len(rows)


def test_search_score_is_the_class_log_loss(data):
    from labelloom.models.factory import fit_predict

    found = Se.cv_run(data, "id", ["a"], SIMPLE, "nb", {"dummy_param": None}, folds=[2]).first()["score"]
    fitted = SIMPLE.fit(data.filter("kfold <> 2"))
    rows = SIMPLE.matrix(fitted.transform(data), ["id", "kfold", "a"]).withColumnRenamed("a", "y")
    out = fit_predict("nb", {}, rows.filter("kfold <> 2"), rows.filter("kfold = 2"), "id", 80).toPandas()
    p = np.where(out["p"] == 0, 1e-15, np.where(out["p"] == 1, 1 - 1e-15, out["p"]))
    want = -(out["y"] * np.log(p) + (1 - out["y"]) * np.log(1 - p)).mean()
    assert np.isclose(found, want)


def test_unknown_classifier_fails_before_any_job(data):
    with pytest.raises(ValueError):
        Se.grid_search(data, "id", ["a"], SIMPLE, {"df": {"max_depth": [1]}})


def documents(data):
    positives = T.positives_from_wide(data, "id", ["a", "b"])
    y = T.ovr_targets(data, positives, "id", ["a", "b", HIDDEN])
    rows = data.drop("a", "b").join(y, "id")
    return rows.filter("id < 70"), rows.filter("id >= 70").drop("a", "b", HIDDEN), positives


def test_baseline_output_has_at_most_one_label_per_row(data):
    train, test, _ = documents(data)
    p = Sc.score_baseline(train, test, "id", ["a", "b", HIDDEN], SIMPLE)
    assert p.filter(F.col("label") == HIDDEN).count() == 0
    assert p.groupBy("id").count().filter("count > 1").count() == 0
    wide = Sc.submission_wide(p, test, "id", ["a", "b", "never"])
    assert wide.columns == ["id", "a", "b", "never"] and wide.count() == 30
    assert wide.filter("never <> 0 or a is null").count() == 0


def test_tuned_output_keeps_all_classes(data):
    train, test, _ = documents(data)
    p = Sc.score_tuned(train, test, "id", ["a", "b", HIDDEN], SIMPLE, {"b": 0.1, "a": 1.0, HIDDEN: 1.0})
    assert p.groupBy("id").count().filter("count <> 2").count() == 0
    assert p.filter("p < 0 or p > 1").count() == 0


def test_multilabel_cross_validation(data):
    train, _, positives = documents(data)
    out = Se.multilabel_cv(train, "id", ["a", "b", HIDDEN], positives, 2, SIMPLE, folds=[0, 1]).collect()
    assert sorted(r["fold"] for r in out) == [0, 1] and all(r["score"] > 0 for r in out)


def test_greedy_keeps_only_improvements(data):
    candidates = [("g", SIMPLE), ("same", SIMPLE)]
    rows = Se.greedy_feature_sets(data, "id", ["a"], candidates, "nb", {"d": None}, folds=[0, 1]).collect()
    assert [r["kept"] for r in rows] == [True, False]


def test_control_rows(spark):
    p = spark.createDataFrame([(1, "a", 0.4), (2, "a", 0.6)], "id int, label string, p double")
    cats = spark.createDataFrame([(1, "ctl"), (2, "trt")], "id int, kind string")
    got = {r["id"]: r["p"] for r in Sc.control_rows_zero(p, cats, "id", F.col("kind") == "ctl").collect()}
    assert got == {1: 0.0, 2: 0.6}


# ---- sources and sinks
def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s1", 0.1, 3), ("s2", 1e-17, None)], "id string, p double, n int")
    path = sinks.write_csv(df, str(tmp_path / "out"))
    back = tables.scan_table(spark, path, df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert dict(tables.scan_table(spark, path).dtypes)["p"] == "double"


def test_results_replace_only_their_run(spark, tmp_path):
    path = str(tmp_path / "results")
    schema = "run string, class string, score double"
    sinks.write_results(spark.createDataFrame([("r1", "a", 1.0), ("r2", "a", 2.0)], schema), path)
    sinks.write_results(spark.createDataFrame([("r2", "a", 5.0)], schema), path)
    got = {r["run"]: r["score"] for r in sinks.read_results(spark, path).collect()}
    assert got == {"r1": 1.0, "r2": 5.0}


def test_models_are_stored_per_fold(spark, data, tmp_path):
    train = data.select(array_to_vector("g").alias("features"), F.col("a").cast("double").alias("y"))
    model = Pipeline(stages=[logistic(1.0, 100)]).fit(train)
    sinks.save_model(model, str(tmp_path), 3)
    back = sinks.load_model(str(tmp_path), 3)
    assert np.allclose(back.stages[0].coefficients, model.stages[0].coefficients)


def test_catalog_registers_views(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "t.parquet"))
    catalog = tables.Catalog(spark, {"four": str(tmp_path / "t.parquet")})
    catalog.register()
    assert spark.sql("select count(*) from four").first()[0] == 4


def test_settled_tables_can_be_cleared(spark):
    df = session.settle(spark.range(5))
    assert df.count() == 5
    assert session.clear_settled(spark) >= 1
