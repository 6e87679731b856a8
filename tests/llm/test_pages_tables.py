"""Main text, URL lists, tool calls, WARC, nearest vectors, and the queries with SQL."""

import datetime
import hashlib
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from check_queries import TABLES, compare  # noqa: E402
from labelloom.llm import chat, nearest, pages, queries, urls, warc  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_main_text():
    page = (
        "<html><head><title>t</title><style>p{}</style><script>var a='<p>x</p>'</script></head><body>"
        "<header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav><div class='ad'>Buy</div>"
        "<div class=cookie-notice>We use cookies</div><article><h1>Big &amp; small</h1><p><b>One  long\nparagraph of text here."
        "<br><p>No.<form><input><p>mail</form><p>Another paragraph &#233; with words in it.</p>"
        "<div id=comments><p>first!</p></div></article><aside>more</aside><footer>c</footer>"
    )
    want = "Big & small\nOne long paragraph of text here.\nNo.\nAnother paragraph é with words in it."
    assert pages.main_text(page) == want
    assert pages.main_text(page.replace("article>", "main>")) == want
    assert pages.main_text(None) == "" and pages.main_text("") == "" and pages.main_text("<nav>x</nav>") == ""
    assert pages.main_text("plain words only") == "plain words only"
    long = "<article>" + "<p>some words in a row</p>" * 20_000
    assert pages.main_text(long).count("\n") == 19_999
    for broken in ("<", "<!", "<![x", "</", "<a b='", "&#x", "<p></div></p>", "<!--", "<script>"):
        pages.main_text(broken)


def test_main_text_column(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "<p>x</p>", None)], "page_id long, html string, url string")
    assert [r["text"] for r in pages.with_text(df).orderBy("page_id").collect()] == ["", "", "x"]
    assert pages.with_text(df.limit(0)).count() == 0


def test_url_lists(spark):
    d = datetime.date
    entries = spark.createDataFrame(
        [("bad.org", "block", d(2024, 1, 10)), ("bad.org", "remove", d(2024, 2, 1)), ("ok.bad.org", "allow", d(2024, 1, 1)),
         ("ok.bad.org/x/", "block", d(2024, 1, 5)), (None, "block", d(2024, 1, 1)), ("bad.org", "allow", d(2024, 1, 10))],
        "pattern string, action string, since date",
    )
    seen = spark.createDataFrame(
        [(1, "http://Bad.org/", d(2024, 1, 9)), (2, "http://bad.org/", d(2024, 1, 10)), (3, "http://a.bad.org:80/x", d(2024, 1, 31)),
         (4, "http://bad.org", d(2024, 2, 1)), (5, "https://ok.bad.org/x/y", d(2024, 1, 20)), (6, "https://ok.bad.org/xy", d(2024, 1, 20)),
         (7, None, d(2024, 1, 20)), (8, "http://bad.org/", None), (9, "nonsense", d(2024, 1, 20)), (2, "http://bad.org/", d(2024, 1, 10))],
        "page_id long, url string, at date",
    ).withColumn("pattern", F.lit("clash"))
    got = {r["id"]: (r["decision"], r["n_active"]) for r in urls.decided(seen, entries, "page_id", "url", "at").collect()}
    none = ("none", 0)
    assert got == {1: none, 2: ("block", 1), 3: ("block", 1), 4: none, 5: ("block", 3), 6: ("allow", 2), 7: none, 8: none, 9: none}
    assert urls.decided(seen, entries.limit(0), "page_id", "url", "at").filter("decision <> 'none'").count() == 0
    assert urls.decided(seen.limit(0), entries, "page_id", "url", "at").count() == 0


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, "a", "add", '{"y": 2, "x": 1}', None), (1, "b", "add", '{"x":"1"}', "a"), (1, "c", "add", "[1]", "b"),
         (1, "d", "add", None, "e"), (1, "e", "add", '{"x":1,"y":200,"z":true}', "d"), (2, "f", "who", "{}", "gone"),
         (2, None, "add", "{}", None), (1, "a", "add", '{"y": 2, "x": 1}', None), (2, "g", "add", '{"x":1', "c")],
        "conv_id long, call_id string, name string, arguments string, after string",
    )
    results = spark.createDataFrame([("a", 'r"1'), ("a", "z"), ("q", "lost"), (None, "n")], "call_id string, content string")
    schemas = spark.createDataFrame(
        [("add", "x", "integer", True, None, None), ("add", "y", "number", True, 0.0, 100.0)],
        "name string, field string, type string, required boolean, low double, high double",
    )
    got = {r["call_id"]: r for r in chat.linked(calls, results, schemas).collect()}
    assert {k: r["depth"] for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "f": 0, "g": 3}
    assert {k: r["errors"] for k, r in got.items()} == {
        "a": "", "b": "x: wrong type; y: missing", "c": "no object", "d": "no object",
        "e": "y: out of range; z: unknown field", "f": "unknown tool", "g": "no object",
    }
    assert got["a"]["canonical"] == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","result":"r\\"1"}'
    assert (got["a"]["n_results"], got["a"]["n_calls"], got["b"]["n_results"]) == (2, 2, 0)
    assert chat.linked(calls.limit(0), results, schemas).count() == 0


def test_warc_round_trip(spark):
    magic = warc.MAGIC
    fake = magic + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [
        (1, "u", fake * 3 + "x"), (2, "u\r\nContent-Length: 5", None), (3, None, "é" * 600), (4, "v", "é" * 600),
        (None, "z", "é" * 600), (5, "a", "WARWARC/1.1\r\nWAR" + magic), (6, "b", "tail" + magic[:-1]),
        (7, "c", "q" * 1200 + fake), (8, "c", "q" * 1200 + fake), (9, "c", "long " * 100_000),
    ] + [(i, "d", f"p{i}" + magic * (i % 3)) for i in range(20, 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2).withColumn("digest", F.lit(1))
    got = {r["id"]: r for r in warc.archived(df).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i]["bytes"], got[i]["digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
    again = {i: r["original"] for i, r in got.items() if r["kind"] == "revisit"}
    assert again == {3: 4, None: 4, 7: 8}
    assert warc.archived(df.limit(0)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, size=(3000, 1))
    rows = [(i, v.tolist(), "q") for i, v in enumerate(x)]
    rows += [(3001, None, ""), (3002, [0.0] * 16, ""), (3003, [float("nan")] * 16, ""), (3004, [None] * 16, ""), (0, x[0].tolist(), "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = nearest.search(df, F.col("id") % 100 == 0, 10).toPandas()
    hits = 0
    for q in range(0, 3000, 100):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.argsort(-s)[:10].tolist())
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and mine.score.is_monotonic_decreasing
        assert mine.score.to_numpy() == pytest.approx(s[mine.vec_id.to_numpy()])
        hits += len(best & set(mine.vec_id))
    assert hits / 300 >= 0.9
    few = nearest.search(df.filter("vec_id < 4"), F.col("id") == 0, 10)
    assert few.count() == 3
    assert nearest.search(df.limit(0), F.col("id") == 0, 10).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got, want = queries.queries()[name](spark, FOLDER).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert compare(got.astype(object), want.astype(object)) == "ok" or compare(got, want) == "ok"


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    ids = [r["doc_id"] for r in out.select("doc_id").distinct().collect()]
    assert 0 < len(ids) < 200
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
