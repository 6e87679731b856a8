"""The threshold of the quality rules follows the labels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import quality

FOLDER = "/root/testdata/sf0.1"


def test_least_error_cut_equals_brute_force():
    rng = random.Random(2)
    for _ in range(50):
        junk = [rng.choice([rng.gauss(-1, 1), rng.randrange(-3, 3)]) for _ in range(rng.randrange(1, 30))]
        good = [rng.choice([rng.gauss(1, 1), rng.randrange(-3, 3)]) for _ in range(rng.randrange(1, 30))]
        errors = lambda t: sum(x >= t for x in junk) + sum(x < t for x in good)
        cut = quality.least_error_cut(np.array(junk), np.array(good))
        assert errors(cut) == min(errors(t) for t in [*junk, *good, 100.0])
    assert quality.least_error_cut(np.array([-3.0, -2.0]), np.array([0.0, 1.0])) == -1.0
    assert quality.least_error_cut(np.array([1.0]), np.array([1.0])) == 1.0


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs, labels).select("row.doc_id", "row.lang", "base_failed", "score", "kept")
    return rows.toPandas().query("not base_failed").merge(labels.toPandas(), on="doc_id")


def test_junk_of_every_language_goes(judged):
    junk, good = judged[judged.quality == 0], judged[judged.quality == 1]
    assert junk.lang.nunique() == 4
    assert (junk.groupby("lang").kept.mean() < 0.06).all()
    assert (good.groupby("lang").kept.mean() > 0.99).all()
    errors = lambda t: (junk.score >= t).sum() + (good.score < t).sum()
    assert junk.kept.sum() + (~good.kept).sum() == min(errors(t) for t in np.linspace(-0.3, 0.1, 4001)) < errors(quality.THRESHOLD)


def test_few_labels_leave_the_default(spark):
    docs = spark.createDataFrame([(i, f"a b c d e f g h i j k w{i}") for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    ratio = quality.ratios(docs, quality.trusted_ids(labels))
    assert quality.fit_threshold(docs, labels, ratio) == quality.THRESHOLD
    assert quality.fit_threshold(docs, labels.limit(0), ratio) == quality.THRESHOLD
