"""One pack of rows and one range-wise ranking for all folds and classes."""

import numpy as np
import pytest

from labelloom.models import batched as B
from labelloom.operators import metrics as M
from labelloom.plans import recipe as Rc
from labelloom.plans import search as Se

CLASSES = ["a", "b", "none", "late"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 3)) * [1.0, 50.0, 0.01] + [0.0, 900.0, 5.0]
    fold = np.arange(240) % 4
    x[:, 2] = np.where(fold == 1, x[:, 2], 5.0)  # constant in the training rows of fold 1
    a, b = x[:, 0] + rng.normal(size=240) > 0, x[:, 1] + 60 * rng.normal(size=240) > 900
    late = (fold == 2) & (x[:, 0] > 0)  # no positive outside fold 2
    data = [
        (i, None if i == 7 else int(fold[i]), [float(v) for v in x[i]], [1.0, float(i % 2)], int(a[i]), int(b[i]), 0, int(late[i]))
        for i in range(240)
    ]
    schema = "id int, kfold int, x array<double>, flags array<double>, a int, b int, none int, late int"
    return spark.createDataFrame(data, schema)


RECIPE = Rc.Recipe([Rc.Scale(["x"])], ["flags", "x"])


def test_rows_are_packed_once_for_all_folds(rows, monkeypatch):
    packs = []

    def packed(given, classes):
        packs.append(given.count())
        return B.packed(given, classes)

    monkeypatch.setattr(Se, "packed", packed)
    Se.out_of_fold(rows, "id", CLASSES, RECIPE, "log_reg", {"C": 1.0}, range(4))
    assert packs == [239]  # one row has no fold; before, every row was packed for three folds


def test_shared_rows_give_the_models_of_each_fold(rows, monkeypatch):
    for folds in (range(4), [2]):
        found = {(r["class"], r["id"]): r for r in Se.out_of_fold(rows, "id", CLASSES, RECIPE, "log_reg", {"C": 1.0}, folds).collect()}
        with monkeypatch.context() as m:
            m.setattr(Rc.Recipe, "views", lambda *_: None)
            want = Se.out_of_fold(rows, "id", CLASSES, RECIPE, "log_reg", {"C": 1.0}, folds).collect()
        assert len(want) == len(found) == (239 if len(folds) == 4 else 60) * 4
        for r in want:
            got = found[r["class"], r["id"]]
            assert (got["fold"], got["y"]) == (r["fold"], r["y"]) and got["p"] == pytest.approx(r["p"], abs=1e-8)
            assert r["class"] != "none" or got["p"] == 0.0


def test_only_scalings_are_views(rows):
    rows = rows.filter("kfold is not null")
    fitted = RECIPE.fit_folds(rows, [0, 1])
    views = RECIPE.views(rows, fitted)
    first, second = (np.array(RECIPE.matrix(fitted[f].transform(rows), ["id"]).orderBy("id").toPandas()["x"].tolist()) for f in (0, 1))
    one = np.hstack([first, np.ones((239, 1))])
    assert np.allclose(one @ views[1], np.hstack([second, np.ones((239, 1))])) and np.allclose(views[0], np.eye(6))
    for steps in ([Rc.Scale(["x"]), Rc.Scale(["x"])], [Rc.Pca(["x"], k=2)]):
        other = Rc.Recipe(steps, ["x"])
        assert other.views(rows, other.fit_folds(rows, [0, 1])) is None


def test_ranges_count_every_pair_and_tie(spark, monkeypatch):
    rng = np.random.default_rng(5)
    odd = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0]
    data = [
        (g, int(h), odd[rng.integers(6)] if rng.random() < 0.3 else float(rng.integers(-9, 9)) / 7, [0, 1, None][rng.integers(3)])
        for g in ("a", None, "") for h in (1, 2) for _ in range(120)
    ]
    df = spark.createDataFrame(data, "g string, h int, s double, y int").repartition(3)

    def place(s):
        return (0, 0) if s is None else (2, 0) if s != s else (1, s)

    def brute(part):
        up, down = ([place(s) for _, _, s, y in part if y == v] for v in (1, 0))
        return sum((u > d) + 0.5 * (u == d) for u in up for d in down) / (len(up) * len(down))

    for size, sent in ((M.RANGE, M.SENT), (23, 50)):
        monkeypatch.setattr(M, "RANGE", size)
        monkeypatch.setattr(M, "SENT", sent)
        found = {(r["g"], r["h"]): r["auc"] for r in M.auc(df, ["g", "h"], "s", "y").collect()}
        assert len(found) == 6
        assert all(v == pytest.approx(brute([r for r in data if r[:2] == k])) for k, v in found.items())
        assert M.auc(df, [], "s", "y").first()["auc"] == pytest.approx(brute(data))


def test_wide_scores_are_evaluated_as_long_ones(rows):
    args = (rows, "id", CLASSES, RECIPE, "log_reg", {"C": 1.0}, range(4))
    wide, long = Se.out_of_fold(*args, wide=True), Se.out_of_fold(*args)
    assert wide.columns == ["fold", "id", "y", "p"] and wide.count() == 239 and long.count() == 239 * 4
    metrics = ["log_loss", "auc", "accuracy"]
    for by in (["class", "fold"], ["fold", "class"], ["class"]):
        want = {tuple(r[c] for c in by): r for r in Se.evaluated(long, metrics, by).collect()}
        found = Se.evaluated(wide, metrics, by, CLASSES).collect()
        assert len(found) == len(want)
        for r in found:
            for m in metrics:
                w = want[tuple(r[c] for c in by)][m]
                assert r[m] is w is None or r[m] == pytest.approx(w, abs=1e-7)
    with pytest.raises(ValueError):
        Se.out_of_fold(rows, "id", CLASSES, RECIPE, "knn", {"n_neighbors": 4}, wide=True)
