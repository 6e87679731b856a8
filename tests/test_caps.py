"""What cross-validation and searches must not cut silently."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.models import trees
from labelloom.operators import pca as K
from labelloom.plans import recipe as Rc
from labelloom.plans import search as Se


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 5)) * [1, 2, 3, 4, 5] + 2
    rows = [(i, x[i].tolist(), i % 3, int(x[i, 0] > 2)) for i in range(90)]
    return spark.createDataFrame(rows, "id int, x array<double>, kfold int, a int").persist()


@pytest.mark.parametrize("threshold,center,scaled,k", [(0.95, True, True, 2), (0.9, False, False, 2), (None, False, True, 3), (None, True, True, None)])
def test_components_per_fold_equal_a_fit_on_the_other_folds(data, threshold, center, scaled, k):
    step = Rc.Pca(["x"], k, threshold, center, scaled)
    for f, apply in step.fit_folds(data, [0, 1, 2]).items():
        direct = K.fit_pca(data.filter(F.col("kfold") != f), "x", k, threshold, center, scaled)
        got = apply(data).orderBy("id").select("pcx").first()[0]
        want = K.pca_scores(data, "x", direct, "s").orderBy("id").first()
        assert len(got) == len(direct.axes) > (2 if threshold == 0.95 else 0)
        assert np.allclose(got, [want[f"s{i + 1}"] for i in range(len(direct.axes))], atol=1e-7)


def test_search_with_a_component_threshold(data):
    recipe = Rc.Recipe([Rc.Pca(["x"], threshold=0.95)], ["pcx"])
    found = Se.cv_run(data, "id", ["a"], recipe, "nb", {"dummy_param": None}, folds=range(3))
    assert found.count() == 3


@pytest.mark.parametrize("make", [trees.forest, trees.single_tree, trees.boosted])
def test_depths_beyond_the_limit_are_rejected(make):
    assert make(max_depth=30).getMaxDepth() == 30
    with pytest.raises(ValueError):
        make(max_depth=31)


def test_search_rejects_such_depths_before_any_job():
    for clf in ("rf", "dt", "xgb"):
        with pytest.raises(ValueError, match="limit"):
            Se.grid_search(None, "id", ["a"], None, {clf: {"max_depth": [8, 31]}})
