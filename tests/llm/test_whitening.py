"""Whitening against a dense eigen-decomposition and exact sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import whitening


def plain(rows, most=16):
    """rows: (vec_id, vector) that take part -> values, scores (rows x k), deviations, n."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    scores = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x]) @ vectors / np.sqrt(values)
    trace = (centred**2).sum() / n
    return values / trace, scores, [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x], n


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, x string, v string")


def test_equals_dense_solution(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 20)) * np.linspace(3, 0.5, 20) @ np.linalg.qr(rng.normal(size=(20, 20)))[0]
    rows = [(i, base[i % 400].tolist()) for i in range(700)]  # 300 rows repeat a vector
    odd = [(900, None), (901, []), (902, [None] * 20), (903, [math.nan] * 20), (904, [math.inf] * 20), (905, [1e300] * 20), (906, [1.0])]
    df = frame(spark, [(i, v, "x", None) for i, v in rows + odd]).repartition(7)
    got = whitening.whitened(df, "vec_id", "embedding").orderBy("vec_id", "component").toPandas()
    share, scores, deviations, n = plain(rows)
    assert len(got) == 700 * 16 and set(got["n"]) == {n} and n == 400
    mine = got["whitened"].to_numpy().reshape(700, 16)
    sign = np.sign((mine * scores).sum(axis=0))
    assert np.abs(mine * sign - scores).max() < 1e-9
    assert np.abs(got["explained"].to_numpy()[:16] / share - 1).max() < 1e-10
    assert got["deviation"].tolist()[::16] == deviations
    assert got["identity_error"].max() < 1e-10


def test_constant_and_single_vectors(spark):
    rows = [(i, [1.0, float(i % 3), 2.0 * (i % 3)], None, None) for i in range(9)] + [(0, [1.0, 0.0, 0.0], None, None)]
    got = whitening.whitened(frame(spark, rows), "vec_id", "embedding").orderBy("vec_id", "component").collect()
    assert len(got) == 30
    assert [(r.component, r.whitened is None, round(r.explained, 9)) for r in got if r.vec_id == 1] == [(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)]
    one = whitening.whitened(frame(spark, [(1, [0.5, -0.5], None, None)] * 3), "vec_id", "embedding").collect()
    assert [(r.vec_id, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0, 0.0)] * 6


def test_empty_and_null_tables(spark):
    for rows in ([], [(1, None, None, None), (None, [], "a", "b")]):
        got = whitening.whitened(frame(spark, rows, "float"), "vec_id", "embedding")
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert got.collect() == []


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2**36 * (i - 1)), float(i)]) for i in range(4)]
    got = whitening.whitened(frame(spark, [(i, v, None, None) for i, v in rows]), "vec_id", "embedding")
    want = [d if d < 2**63 else None for d in plain(rows)[2]]
    assert [r.deviation for r in got.filter("component = 1").orderBy("vec_id").collect()] == want
    assert None in want


@pytest.mark.parametrize("kind", ["random", "graded", "repeated", "short", "zero", "one"])
def test_singular_values_and_vectors(kind):
    rng = np.random.default_rng(1)
    r = {
        "random": np.linalg.qr(rng.normal(size=(500, 32)), mode="r"),
        "graded": np.linalg.qr(rng.normal(size=(500, 32)) * np.logspace(0, -9, 32), mode="r"),
        "repeated": np.diag(np.repeat([5.0, 3.0, 1.0], [8, 8, 8])),
        "short": np.vstack([rng.normal(size=(5, 12)), np.zeros((7, 12))]),
        "zero": np.zeros((6, 6)),
        "one": np.array([[-2.5]]),
    }[kind]
    diagonal, above, v = whitening.bidiagonal(r)
    squares = whitening.dqds(diagonal, above)
    want = np.linalg.svd(r, compute_uv=False)
    live = want > 1e-12 * want.max(initial=1.0)
    assert np.abs(np.sqrt(squares[live]) / want[live] - 1).max(initial=0.0) < 1e-7 * (kind == "graded") + 1e-12
    axes = v @ whitening.singular_vectors(diagonal, above, squares[live])
    assert np.abs(axes.T @ axes - np.eye(live.sum())).max(initial=0.0) < 1e-11
    assert np.abs(r.T @ (r @ axes) - axes * squares[live]).max(initial=0.0) <= 1e-13 * max(squares[0], 1.0)


def test_dqds_keeps_relative_accuracy():
    """Product form: a bidiagonal matrix with tiny values and an exact smallest one."""
    diagonal, above = np.array([1.0, 1e-5, 1e-9]), np.array([1e-3, 1e-8])
    squares = whitening.dqds(diagonal, above)
    assert math.isclose(math.prod(map(math.sqrt, squares)), math.prod(diagonal), rel_tol=1e-13)


def test_query_covers_table(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=18).tolist(), None, None) for i in range(60)]
    frame(spark, rows, "float").withColumn("label", F.lit(1)).write.parquet(f"{tmp_path}/embeddings.parquet")
    from labelloom.llm import queries

    got = queries.op12_embedding_whitening(spark, str(tmp_path))
    assert got.count() == 60 * 16 and got.schema["deviation"].dataType.simpleString() == "bigint"
