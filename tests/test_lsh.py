"""Hash-table neighbours against the exact search."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelloom.models.lsh import buckets, cell_width, knn_lsh
from labelloom.models.neighbours import neighbours
from labelloom.queries import queries

SCHEMA = "id long, x array<double>"


def frame(spark, vectors, start=0):
    rows = [(start + i, [None if v is None else float(v) for v in x]) for i, x in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def got(df):
    return sorted(tuple(r) for r in df.select("id", "neighbour", "rank").collect())


@pytest.fixture(scope="module")
def grouped():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(100, 12)) * 4
    return centres[rng.integers(0, 100, 3000)] + rng.normal(size=(3000, 12)) / 2


def test_recall_and_visited_share(spark, grouped):
    train, queries = frame(spark, grouped[200:]), frame(spark, grouped[:200], 10_000)
    found = knn_lsh(train, queries, "id", "x", 5, block_rows=256).toPandas()
    exact = neighbours(train, queries, "id", "x", 5).toPandas()
    assert len(found) == len(exact)
    both = found.merge(exact, on=["id", "neighbour"], suffixes=("", "_exact"))
    assert len(both) >= 0.9 * len(exact)
    assert np.allclose(both["distance"], both["distance_exact"], rtol=1e-12)


def test_buckets_hold_what_is_near(spark, grouped):
    """The width fitted to the sample meets few rows, and the probes find what fell over a border."""
    x, q = grouped[200:], grouped[:200]
    squares = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    width = cell_width(frame(spark, x), 1, 0.95, 8, 10, 30, 0)
    own = buckets(x, width, 8, 10)
    shares = []
    for probes in (0, 30):
        seen = buckets(q, width, 8, 10, probes)
        met = (own[None, :, :, :] == seen[:, None, :, :]).any(axis=(2, 3))
        shares.append((np.take_along_axis(met, squares.argmin(axis=1)[:, None], 1).mean(), met.mean()))
    assert shares[1][0] > shares[0][0] and shares[1][0] >= 0.9 and shares[1][1] < 0.1


def test_probes_are_the_cheapest_cells():
    x = np.random.default_rng(1).normal(size=(20, 4))
    all_of = buckets(x, 1.0, 2, 3, 6 + 12)
    assert all(len(set(row.tolist())) == 19 for table in np.moveaxis(all_of, 1, 0) for row in table)
    few = buckets(x, 1.0, 2, 3, 4)
    assert all(set(a) <= set(b) for a, b in zip(few.reshape(40, -1).tolist(), all_of.reshape(40, -1).tolist(), strict=True))


def test_copies_ties_and_split_buckets(spark):
    rng = np.random.default_rng(2)
    near = rng.normal(size=(300, 3)) / 1000
    vectors = np.vstack([np.zeros((300, 3)), near, rng.normal(size=(50, 3)) * 50])
    train, queries = frame(spark, vectors), frame(spark, np.vstack([np.zeros((40, 3)), near[:10]]), 1000)
    found = got(knn_lsh(train, queries, "id", "x", 3, recall=1.0, block_rows=64))
    assert [r[1] for r in found if r[0] < 1040] == [0, 1, 2] * 40
    assert found == got(neighbours(train, queries, "id", "x", 3))


def test_every_query_keeps_its_rows(spark):
    train = frame(spark, [[0, 0], [1, 1], [1e6, 0], [math.nan, 0], [None, 1]])
    queries = frame(spark, [[0, 0], [-1e6, 5], [math.nan, 1], [None, 2]], 10)
    found = knn_lsh(train, queries, "id", "x", 2).orderBy("id", "rank").collect()
    assert [(r["id"], r["neighbour"]) for r in found] == [
        (10, 0), (10, 1), (11, 0), (11, 1), (12, 0), (12, 1), (13, 0), (13, 1)
    ]
    more = knn_lsh(train, queries.filter("id = 10"), "id", "x", 9).collect()
    assert sorted(r["neighbour"] for r in more) == [0, 1, 2, 3, 4]


def test_empty_tables_keys_and_parameters(spark):
    train = frame(spark, [[0, 0], [1, 1]])
    assert knn_lsh(train, train.limit(0), "id", "x", 1).count() == 0
    assert knn_lsh(train.limit(0), train, "id", "x", 1).count() == 0
    rows = train.select(F.col("id").cast("string").alias("sig"), F.col("x").alias("x.y"), F.lit(1).alias("bucket"))
    out = knn_lsh(rows, rows, "sig", "x.y", 1)
    assert out.columns == ["sig", "neighbour", "distance", "rank"]
    assert sorted(r[:2] for r in out.collect()) == [("0", "0"), ("1", "1")]
    with pytest.raises(ValueError, match="positive"):
        knn_lsh(train, train, "id", "x", 0)


def test_query_against_the_exact_shares(spark):
    found = queries()["knn_lsh"](spark, "/root/testdata/sf0.001").toPandas()
    exact = queries()["knn_proba"](spark, "/root/testdata/sf0.001").toPandas()
    assert set(found["vec_id"]) == set(exact["vec_id"])
    both = pd.merge(found, exact, on=["vec_id", "class"], suffixes=("", "_exact"))
    assert (both[["p", "p_exact"]].min(axis=1)).sum() >= 0.9 * exact["p"].sum()
