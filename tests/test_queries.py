"""Every query with SQL against DuckDB on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_points  # noqa: E402
from check_queries import TABLES, compare  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, FOLDER).toPandas(), duck.sql(SQL[name]).df()) == "ok"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"greedy_feature_sets", "grid_search"}))
def test_query_without_sql_gives_rows(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    out = entry_points.entry(spark).collect()
    assert sorted({r["fold"] for r in out}) == [0, 1, 2, 3, 4] and len(out) == 65
    assert all(0 < r["log_loss"] < 1 and 0.5 < r["accuracy"] <= 1 and (r["auc"] is None or 0 <= r["auc"] <= 1) for r in out)
