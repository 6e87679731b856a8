"""Hosts that hide, long URLs, and vectors whose squares over- or underflow."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelloom.llm import nearest, pages, urls

DAY = datetime.date(2024, 1, 10)


def decisions(spark, found, patterns):
    entries = spark.createDataFrame([(p, "block", DAY) for p in patterns], "pattern string, action string, since date")
    seen = spark.createDataFrame([(i, u, DAY) for i, u in enumerate(found)], "id long, url string, at date")
    got = urls.decided(seen, entries, "id", "url", "at").orderBy("id").collect()
    return [(r["host"], r["decision"]) for r in got]


def test_hosts_that_hide(spark):
    hidden = [
        "http://user:pw@bad.org/", "http://u@bad.org", "http://bad.org./x", "http://a.bad.org..:80/", "//bad.org/", " http://BAD.org/",
    ]
    got = decisions(spark, hidden, ["bad.org"])
    assert [g[1] for g in got] == ["block"] * 6
    assert [g[0] for g in got] == ["bad.org", "bad.org", "bad.org", "a.bad.org", "bad.org", "bad.org"]
    free = ["http://good.org/@bad.org", "http://good.org/?u=//bad.org/", "mailto:u@bad.org", "bad.org", "http://notbad.org/", "http:///x", ""]
    assert [d for _, d in decisions(spark, free, ["bad.org"])] == ["none"] * 7


def test_long_urls_and_paths(spark):
    long = ["http://bad.org/" + "a/" * 300_000, "http://" + "x." * 50_000 + "bad.org/a/b/c"]
    assert [d for _, d in decisions(spark, long, ["bad.org/a/a/"])] == ["block", "none"]
    assert [d for _, d in decisions(spark, long, ["bad.org", "bad.org/a/"])] == ["block", "block"]
    assert [d for _, d in decisions(spark, ["http://b.org/a/b", "http://b.org/a/b/"], ["b.org/a/b/"])] == ["none", "block"]
    assert [d for _, d in decisions(spark, ["http://b.org/a/"], [])] == ["none"]


def vectors(scale):
    x = np.random.default_rng(3).uniform(-1, 1, size=(60, 4)) * scale
    x[7] = x[7] / scale  # one of another length
    return x


def check_nearest(got, x):
    assert sorted(got["query_id"].value_counts().items()) == [(0, 5), (20, 5), (40, 5)]
    with np.errstate(over="ignore", invalid="ignore"):
        for q, rows in got.groupby("query_id", sort=True):
            s = np.einsum("ij,j->i", x, x[q])
            s[np.isnan(s)] = -np.inf
            assert rows["vec_id"].tolist() == sorted(set(range(60)) - {q}, key=lambda i: (-s[i], i))[:5]


@pytest.mark.parametrize("scale", [1e-200, 1e200, 1e308, 1e-320, 1.0])
def test_vectors_of_any_length(scale):
    x = vectors(scale)
    rows = pd.DataFrame({"id": np.arange(60), "v": list(x)})
    check_nearest(nearest.search_block(rows[rows["id"] % 20 == 0], rows, 5), x)


def test_search_over_short_and_long_vectors(spark):
    x = vectors(1e-200)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest.search(df, F.col("id") % 20 == 0, 5).toPandas()
    check_nearest(got.sort_values(["query_id", "rank"]), x)


def test_a_column_named_as_the_result(spark):
    df = spark.createDataFrame([(1, "<p>x y</p>", 5)], "page_id long, html string, text int")
    assert pages.with_text(df).first()["text"] == "x y"
