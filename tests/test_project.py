"""Wide CSV in, tuned scored CSV out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators.profile import conformance_check
from labelloom.plans import project as Pj
from labelloom.plans.search import RESULT_COLUMNS, grid_search
from labelloom.roles import HIDDEN, Roles
from labelloom.sources.sinks import write_csv
from labelloom.sources.tables import Catalog, scan_table

ROLES = Roles("sig_id", ("cp_type", "cp_time"), ("g", "c"), {"g": "g-", "c": "c-"})
LABELS = ["5-x_inhibitor", "b_agonist", "z_agonist"]


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("project")
    rng = np.random.default_rng(8)
    n = 120
    g, c = rng.normal(size=(n, 4)), rng.normal(size=(n, 3))
    ids = [f"id_{i:03d}" for i in range(n)]
    names = ["sig_id", "cp_type", "cp_time", *[f"g-{i}" for i in range(4)], *[f"c-{i}" for i in range(3)]]
    kinds, times = rng.choice(["trt_cp", "ctl_vehicle"], n), rng.choice([24, 48, 72], n)
    rows = [(ids[i], str(kinds[i]), int(times[i]), *g[i].tolist(), *c[i].tolist()) for i in range(n)]
    y = np.stack([g[:, 0] > 0.4, c[:, 0] > 0.7, g[:, 1] > 1.2], axis=1).astype(int)
    targets = [(ids[i], *map(int, y[i])) for i in range(90)]
    ddl = ", ".join(f"`{c}` double" for c in names[3:])
    wide = spark.createDataFrame(rows, f"sig_id string, cp_type string, cp_time int, {ddl}")
    labels = spark.createDataFrame(targets, "sig_id string, " + ", ".join(f"`{c}` int" for c in LABELS))
    paths = {k: str(folder / k) for k in ("train", "test", "labels", "folds", "output")}
    write_csv(wide.filter("sig_id < 'id_090'"), paths["train"])
    write_csv(wide.filter("sig_id >= 'id_090'"), paths["test"])
    write_csv(labels, paths["labels"])
    return Catalog(spark, paths)


@pytest.fixture(scope="module")
def loaded(catalog):
    train = Pj.load_features(catalog.table("train"), ROLES)
    test = Pj.load_features(catalog.table("test"), ROLES)
    return train, test, Pj.load_labels(catalog.table("labels"), "sig_id")


def test_loading(loaded):
    train, _, labels = loaded
    assert train.columns == ["sig_id", "cp_type", "cp_time", "g", "c"] and train.count() == 90
    assert labels.names == LABELS


def test_fold_file(catalog, loaded, spark):
    train, _, labels = loaded
    folds = Pj.fold_table(train, labels, "sig_id").select("sig_id", "target", "kfold")
    write_csv(folds, catalog.locations["folds"])
    back = catalog.table("folds")
    assert back.count() == 90 and set(r["kfold"] for r in back.collect()) == set(range(5))
    assert HIDDEN in {r["target"] for r in back.select("target").distinct().collect()}


def test_search_then_tuned_output(catalog, loaded, spark, tmp_path):
    train, test, labels = loaded
    classes = Pj.chosen_classes(train, labels, "sig_id", 2)
    assert len(classes) == 3 and HIDDEN in classes
    frame = Pj.search_frame(train, labels, "sig_id", classes)
    grid = {"log_reg": {"penalty": ["l2"], "C": [0.01, 1.0]}, "knn": {"n_neighbors": [2, 4], "p": [2]}}
    path = str(tmp_path / "results")
    found = Pj.select_models(frame, "sig_id", classes, Pj.base_recipe(ROLES), grid, path)
    assert found.results.count() == 3 * 4 * 5 and found.best.count() == 3
    stored = spark.read.parquet(path)
    assert sorted(map(tuple, stored.select(*RESULT_COLUMNS).collect())) == sorted(
        map(tuple, found.results.collect())
    )
    again = grid_search(frame, "sig_id", classes, Pj.base_recipe(ROLES), grid, done=stored)
    assert again.count() == 60
    strengths = Pj.tuned_strengths(found.per_classifier)
    assert set(strengths) == set(classes) and set(strengths.values()) <= {0.01, 1.0}
    out = Pj.scored_output(train, labels, test, "sig_id", classes, Pj.base_recipe(ROLES), strengths)
    write_csv(out, catalog.locations["output"])
    back = scan_table(spark, catalog.locations["output"], out.schema)
    template = test.select("sig_id", *[F.lit(0.5).alias(c) for c in LABELS])
    assert tuple(conformance_check(back, template, "sig_id").first()) == (True, True, True)


def test_shared_neighbour_search_equals_one_class_at_a_time(loaded):
    from labelloom.models.factory import fit_predict
    from labelloom.operators.metrics import class_log_loss

    train, _, labels = loaded
    classes = ["b_agonist", HIDDEN]
    frame = Pj.search_frame(train, labels, "sig_id", classes)
    recipe = Pj.base_recipe(ROLES)
    grid = {"knn": {"n_neighbors": [2, 4], "p": [2]}}
    found = grid_search(frame, "sig_id", classes, recipe, grid, folds=[1])
    fitted = recipe.fit_folds(frame, [1])[1]
    for r in found.collect():
        rows = recipe.matrix(fitted.transform(frame), ["sig_id", "kfold", r["class"]])
        rows = rows.withColumnRenamed(r["class"], "y")
        k = int(r["params"].split(",")[0].split("=")[1])
        p = fit_predict(
            "knn", {"n_neighbors": k}, rows.filter("kfold <> 1"), rows.filter("kfold = 1"), "sig_id", 72
        )
        assert np.isclose(class_log_loss(p, []).first()[0], r["score"])


def test_feature_recipes_widen_the_matrix(loaded):
    train, _, labels = loaded
    widths = []
    for _, recipe in Pj.feature_recipes(ROLES):
        rows = recipe.matrix(recipe.fit(train).transform(train), ["sig_id"])
        widths.append(len(rows.first()["x"]))
    onehot, combined = 2 + 3, 6
    assert widths == [
        onehot + 7,
        onehot + 7 + 26,
        onehot + combined + 7 + 26,
        onehot + combined + 7 + 26 + 3,
        onehot + combined + 7 + 26 + 3 + 4,
    ]
