import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelloom.operators import ordering as O


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_position_is_the_global_rank_whatever_the_partitioning(spark, parts):
    df = spark.range(500).select("id", (F.col("id") * 37 % 11).alias("k")).repartition(parts)
    got = {r["id"]: r["position"] for r in O.with_position(df, ["k", "id"]).collect()}
    want = {i: n for n, i in enumerate(sorted(range(500), key=lambda i: (i * 37 % 11, i)))}
    assert got == want


def test_position_with_one_dominant_value(spark):
    df = spark.range(600).select("id", F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"))
    rows = O.with_position(df, ["k", "id"]).orderBy("k", "id").collect()
    assert [r["position"] for r in rows] == list(range(600))


def test_running_total(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(200)], "k int, v int").repartition(5)
    rows = O.running_total(df, ["k"], ["v"]).orderBy("k").collect()
    assert [r["cum_v"] for r in rows] == np.cumsum([i % 7 for i in range(200)]).tolist()


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-5, 5)), min_size=1, max_size=60))
def test_quantiles_are_exact(spark, rows):
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g string, v double")
    probs = {"q10": 0.1, "q50": 0.5, "q99": 0.99}
    got = {r["g"]: r for r in O.quantiles(df, ["g"], "v", probs).collect()}
    for g in {g for g, _ in rows}:
        x = [v for h, v in rows if h == g]
        for name, q in probs.items():
            assert np.isclose(got[g][name], np.quantile(x, q))


def test_quantiles_without_groups(spark):
    df = spark.range(11).select(F.col("id").cast("double").alias("v"))
    assert O.quantiles(df, [], "v", {"m": 0.5}).first()["m"] == 5.0


def test_quantiles_skip_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    assert O.quantiles(df, [], "v", {"m": 0.5}).first()["m"] == 2.0


def test_shuffle_is_a_seeded_permutation(spark):
    df = spark.range(100)
    a = [r["id"] for r in O.shuffle_rows(df, "id", 1).collect()]
    b = [r["id"] for r in O.shuffle_rows(df.repartition(7), "id", 1).collect()]
    assert a == b and sorted(a) == list(range(100)) and a != list(range(100))


def test_batches(spark):
    rows = O.row_batches(spark.range(25), ["id"], 10).groupBy("batch").count().orderBy("batch").collect()
    assert [(r["batch"], r["count"]) for r in rows] == [(0, 10), (1, 10), (2, 5)]


def test_preview(spark):
    assert [r["id"] for r in O.head_rows(spark.range(9), "id", 2).collect()] == [0, 1]
    assert [r["id"] for r in O.tail_rows(spark.range(9), "id", 2).collect()] == [8, 7]
