import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from labelloom.operators import columns as C
from labelloom.operators import joins as J
from labelloom.operators import reshape as R
from labelloom.roles import Roles, named, pack, unpack


@pytest.fixture()
def wide(spark):
    return spark.createDataFrame(
        [("s1", "trt", 1.0, 2.0, 3.0), ("s2", "ctl", 4.0, 5.0, 6.0)],
        "sig string, kind string, `g-0` double, `g-1` double, `c-0` double",
    )


def test_pack_and_unpack_are_inverse(wide):
    roles = Roles("sig", ("kind",), ("g", "c"), {"g": "g-", "c": "c-"})
    packed = pack(wide, roles)
    assert packed.columns == ["sig", "kind", "g", "c"]
    back = unpack(packed, {"g": 2, "c": 1}).select(*[named(c) for c in wide.columns])
    assert back.collect() == wide.collect()


def test_selectors(wide):
    assert C.select_prefix(wide, "g-", keep=["sig"]).columns == ["sig", "g-0", "g-1"]
    assert C.select_prefix(wide, "-0", anywhere=True).columns == ["g-0", "c-0"]
    assert C.select_num_range(wide, "g-", [1, 0]).columns == ["g-1", "g-0"]
    assert C.select_positions(wide, 2, 4, keep=["sig"]).columns == ["sig", "g-0", "g-1"]
    assert C.drop_key(wide, "sig").columns[0] == "kind"


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], "`g-0` int, `5-x_y` int")
    assert C.clean_names(df).columns == ["g_0", "5_x_y"]
    assert C.add_prefix(df, "target_", "g-0").columns == ["g-0", "target_5-x_y"]
    assert C.strip_prefix(C.add_prefix(df, "target_", ""), "target_").columns == df.columns


def test_scalar_expressions(spark):
    df = spark.createDataFrame([(0, 0.5, "a_b"), (3, 1.0, "c"), (7, 0.25, "d_e_f")], "n int, p double, s string")
    row = df.select(
        C.bucket_tail(F.col("n")).alias("b"),
        C.replace_value(F.col("p"), 0.5, 0.0).alias("r"),
        C.spaced(F.col("s")).alias("s"),
        C.percent_label(F.col("p")).alias("pct"),
        C.duration_label(F.col("n")).alias("dur"),
        C.log10_count(F.col("n")).alias("lg"),
    ).collect()
    assert [r["b"] for r in row] == ["0", "3+", "3+"]
    assert [r["r"] for r in row] == [0.0, 1.0, 0.25]
    assert [r["s"] for r in row] == ["a b", "c", "d e f"]
    assert row[0]["pct"] == "50.00%" and row[0]["dur"] == "Duration 0h" and row[0]["lg"] is None


def test_zero_rows_where(spark):
    df = spark.createDataFrame([("x", 0.3, 0.4), ("y", 0.5, 0.6)], "k string, a double, b double")
    got = C.zero_rows_where(df, F.col("k") == "x", ["a", "b"]).collect()
    assert [tuple(r) for r in got] == [("x", 0.0, 0.0), ("y", 0.5, 0.6)]


def test_concat_by_key_needs_the_same_keys(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, l string")
    right = spark.createDataFrame([(2, 20), (1, 10)], "k int, r int")
    assert sorted(map(tuple, J.concat_by_key(left, right, "k").collect())) == [(1, "a", 10), (2, "b", 20)]
    with pytest.raises(PySparkException):
        J.concat_by_key(left, right.filter("k = 1"), "k").collect()


def test_lookup_join_has_a_way_beyond_the_broadcast_limit(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "id int, k int")
    table = spark.createDataFrame([(0, "zero"), (1, "one")], "k int, name string")
    small = J.lookup_join(df, table, "k")
    monkeypatch.setattr(J, "BROADCAST_ROWS", 1)
    assert J.frozen_if_small(table) is None
    large = J.lookup_join(df, table, "k")
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert small.filter("name is null").count() == 10


def test_lookup_join_with_an_empty_table(spark):
    df = spark.range(3).withColumnRenamed("id", "k")
    table = spark.createDataFrame([], "k bigint, v string")
    assert [r["v"] for r in J.lookup_join(df, table, "k").collect()] == [None] * 3


def test_targets_and_missing_keys(spark):
    x = spark.createDataFrame([(1,), (2,)], "k int")
    y = spark.createDataFrame([(1, 1)], "k int, lab int")
    assert [tuple(r) for r in J.join_targets(x, y, "k").orderBy("k").collect()] == [(1, 1), (2, None)]
    assert J.join_targets(x, y, "k").columns == ["k", "target_lab"]
    assert [r["k"] for r in J.missing_keys(x, y, "k").collect()] == [2]


def test_split_fill_left(spark):
    df = spark.createDataFrame([("a_b_c",), ("c",), ("a_b_c_d_e",)], "s string")
    got = [tuple(r) for r in df.select(*R.split_fill_left(F.col("s"), "_", ["x", "y", "z"])).collect()]
    assert got == [("a", "b", "c"), (None, None, "c"), ("a", "b", "c")]


def test_melts(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [3.0])], "id int, c array<double>, g array<double>")
    got = [tuple(r) for r in R.melt_packed(df, ["id"], ["c", "g"]).collect()]
    assert got == [(1, "c-0", 1.0), (1, "c-1", 2.0), (1, "g-0", 3.0)]
    two = spark.createDataFrame([(1, 5.0, 6.0, 0, 1)], "id int, f1 double, f2 double, y1 int, y2 int")
    assert R.melt_twice(two, ["id"], ["f1", "f2"], ["y1", "y2"]).count() == 4
