"""Target counts and threshold come from all labelled documents."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import quality

MANY = 20_500


def test_every_good_document_is_trusted(spark):
    labels = spark.range(MANY).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality.trusted_ids(labels.unionByName(labels)).count() == MANY
    docs = labels.select("doc_id", F.lit("one two").alias("text"))
    whole = quality.ratios(docs, quality.trusted_ids(labels)).first()["ratio"]
    assert max(map(abs, whole)) < 1e-12  # target and corpus are the same texts


@pytest.mark.parametrize("large", [False, True])
def test_the_distributed_cut_equals_the_local_one(spark, monkeypatch, large):
    monkeypatch.setattr(quality, "LEAST_LABELLED", 1)
    rng = random.Random(4)
    cases = [(rng.randrange(1, 30), rng.randrange(1, 30), rng.choice([-2, 0, 2])) for _ in range(6)] if not large else [(MANY, MANY, 1)]
    fixed = [([1.0], [1.0]), ([3.0], [1.0, 1.0]), ([3.0, 2.0], [1.0])] if not large else []
    drawn = [([rng.gauss(0, 1) for _ in range(a)], [round(rng.gauss(shift, 1), 2) for _ in range(b)]) for a, b, shift in cases]
    for junk, good in fixed + drawn:
        rows = spark.createDataFrame([(0, x) for x in junk] + [(1, x) for x in good], "label int, score double")
        assert quality.least_error_threshold(rows) == quality.least_error_cut(np.array(junk), np.array(good))


def test_the_threshold_sees_every_label(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, str(rng.gauss(i % 2, 1)), i % 2) for i in range(2 * MANY)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, quality int")
    measure = lambda d, ratio: d.select(F.struct("*").alias("row"), F.lit(False).alias("base_failed"), F.col("text").cast("double").alias("score"))
    monkeypatch.setattr(quality, "scored", measure)
    got = quality.fit_threshold(docs.select("doc_id", "text"), docs.select("doc_id", "quality"), None)
    junk, good = (np.array([float(x) for _, x, y in rows if y == label]) for label in (0, 1))
    assert got == quality.least_error_cut(junk, good)
