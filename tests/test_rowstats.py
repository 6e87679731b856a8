import numpy as np
from pyspark.sql import functions as F

from labelloom.functions.rowstats import STATS, keep_argmax, row_argmax, row_stat, row_stats

NUMPY = {
    "min": np.min,
    "max": np.max,
    "sum": np.sum,
    "mean": np.mean,
    "std": np.std,
    "var": np.var,
    "range": np.ptp,
    "p10": lambda x: np.percentile(x, 10),
    "p60": lambda x: np.percentile(x, 60),
    "p90": lambda x: np.percentile(x, 90),
    "p5": lambda x: np.percentile(x, 5),
    "p95": lambda x: np.percentile(x, 95),
    "p99": lambda x: np.percentile(x, 99),
}


def arrays():
    rng = np.random.default_rng(1)
    return [rng.normal(size=n).tolist() for n in (1, 2, 3, 10, 101)] + [[2.0, 2.0, 2.0]]


def test_all_statistics_match_numpy(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(arrays())], "id int, x array<double>")
    rows = {r["id"]: r for r in row_stats(df, ["x"]).collect()}
    single = df.select("id", *[row_stat(F.col("x"), s).alias(s) for s in STATS])
    alone = {r["id"]: r for r in single.collect()}
    for i, x in enumerate(arrays()):
        for stat, f in NUMPY.items():
            assert np.isclose(rows[i][f"x_{stat}"], f(x), atol=1e-12), (i, stat)
            assert np.isclose(alone[i][stat], f(x), atol=1e-12), (i, stat)


def test_column_order_is_group_then_statistic(spark):
    df = spark.createDataFrame([(1, [1.0], [2.0])], "id int, c array<double>, g array<double>")
    names = row_stats(df, ["c", "g"]).columns
    assert names[3:] == [f"{g}_{s}" for g in "cg" for s in STATS]


def test_empty_array_gives_null(spark):
    df = spark.createDataFrame([(1, [])], "id int, x array<double>")
    row = row_stats(df, ["x"], ["min", "max", "p10"]).first()
    assert row["x_min"] is None and row["x_max"] is None and row["x_p10"] is None


def test_argmax_takes_the_first_of_equal_maxima_and_ignores_nan(spark):
    df = spark.createDataFrame(
        [(1, [0.2, 0.7, 0.7]), (2, [float("nan"), 0.1, 0.0]), (3, [0.0, 0.0, 0.0])],
        "id int, p array<double>",
    )
    got = {r["id"]: r["n"] for r in df.select("id", row_argmax(F.col("p"), ["a", "b", "c"]).alias("n")).collect()}
    assert got == {1: "b", 2: "b", 3: "a"}


def test_keep_argmax_leaves_one_entry(spark):
    df = spark.createDataFrame([([0.2, 0.7, 0.7],), ([0.9, 0.1, 0.3],)], "p array<double>")
    got = [r[0] for r in df.select(keep_argmax(F.col("p"))).collect()]
    assert got == [[0.0, 0.7, 0.0], [0.9, 0.0, 0.0]]


def test_own_statistics(spark):
    df = spark.createDataFrame([(1, [3.0, 1.0, 2.0])], "id int, x array<double>")
    own = {"median": lambda s: F.get(s, F.floor(F.size(s) / 2).cast("int")), "n": F.size}
    row = row_stats(df, ["x"], own).first()
    assert (row["x_median"], row["x_n"]) == (2.0, 3)
