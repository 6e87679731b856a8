from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelloom.operators import splits as S
from labelloom.operators import targets as T
from labelloom.roles import HIDDEN


def test_hidden_class_and_the_skipped_first_label(tiny_labels):
    wide, _ = tiny_labels
    pos = T.positives_from_wide(wide, "id", ["a", "b", "z"])
    assert [r["id"] for r in T.hidden_class(wide, pos, "id").collect()] == [1]
    skipped = T.hidden_class(wide, pos, "id", skip_label="a")
    assert sorted(r["id"] for r in skipped.collect()) == [1, 3]


def test_row_sums(tiny_labels):
    wide, _ = tiny_labels
    pos = T.positives_from_wide(wide, "id", ["a", "b", "z"])
    sums = {r["id"]: r["label_sum"] for r in T.row_label_sum(wide, pos, "id").collect()}
    assert sums == {1: 0, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1}


@pytest.mark.parametrize("empty, first", [("hidden", HIDDEN), ("first", "a"), (None, None)])
def test_label_from_onehot_takes_the_first_positive(tiny_labels, empty, first):
    wide, vocab = tiny_labels
    pos = T.positives_from_wide(wide, "id", ["a", "b", "z"])
    got = {r["id"]: r["label"] for r in T.label_from_onehot(wide, pos, vocab, "id", empty).collect()}
    assert got == {1: first, 2: "b", 3: "a", 4: "z", 5: "b", 6: "b"}


def test_topk_breaks_ties_by_position_and_counts_the_hidden_class(tiny_labels):
    wide, vocab = tiny_labels
    pos = T.positives_from_wide(wide, "id", ["a", "b", "z"])
    top = T.topk_classes(wide, pos, vocab, "id", 3)
    assert [(r["label"], r["n"]) for r in top.collect()] == [("b", 3), ("z", 2), ("a", 1), (HIDDEN, 1)]
    assert [r["label"] for r in T.topk_classes(wide, pos, vocab, "id", 1, hidden=False).collect()] == ["b"]
    lost = T.topk_classes(wide, pos, vocab, "id", 3, skip_label="a").collect()
    assert "a" not in [r["label"] for r in lost]
    assert {r["label"]: r["n"] for r in lost}[HIDDEN] == 2


def test_totals_hold_labels_nobody_has(spark, tiny_labels):
    wide, vocab = tiny_labels
    pos = T.positives_from_wide(wide, "id", ["a", "b", "z"]).filter("label <> 'z'")
    assert {r["label"]: r["n"] for r in T.label_totals(pos, vocab).collect()} == {"a": 1, "b": 3, "z": 0}


def test_hidden_rows_as_a_label_and_the_count_cut_off(tiny_labels):
    wide, vocab = tiny_labels
    pos = T.positives_from_wide(wide, "id", ["a", "b", "z"])
    rows = T.with_hidden(wide, pos, "id")
    assert rows.filter(F.col("label") == HIDDEN).select("id").collect()[0]["id"] == 1
    over = T.classes_over(T.label_totals(pos, vocab), 2)
    assert sorted(r["label"] for r in over.collect()) == ["b", "z"]
    empty = T.empty_predictions(wide, "id", ["a", "b"])
    assert empty.columns == ["id", "a", "b"] and empty.filter("a <> 0 or b <> 0").count() == 0


def test_ovr_targets(tiny_labels):
    wide, _ = tiny_labels
    pos = T.positives_from_wide(wide, "id", ["a", "b", "z"])
    got = {r["id"]: (r["b"], r[HIDDEN]) for r in T.ovr_targets(wide, pos, "id", ["b", HIDDEN]).collect()}
    assert got == {1: (0, 1), 2: (1, 0), 3: (0, 0), 4: (0, 0), 5: (1, 0), 6: (1, 0)}


def test_onehot_and_weights(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "b"), (4, "a")], "id int, label string")
    got = [tuple(r) for r in T.onehot_from_label(df, "label", ["a", "b"]).orderBy("id").collect()]
    assert got == [(1, 0, 1), (2, 0, 0), (3, 0, 1), (4, 1, 0)]
    w = T.class_weights(df.filter("label is not null"), "label").collect()
    assert {r["label"]: r["weight"] for r in w} == {"a": 1.5, "b": 0.75}


def test_class_balance_holds_empty_cells(spark, tiny_labels):
    wide, _ = tiny_labels
    pos = T.with_hidden(wide, T.positives_from_wide(wide, "id", ["a", "b", "z"]), "id")
    folds = spark.createDataFrame([(i, i % 2) for i in range(1, 7)], "id int, kfold int")
    got = {(r["class"], r["kfold"]): (r["positives"], r["n"]) for r in T.class_balance(pos, folds, "id", ["b", HIDDEN]).collect()}
    assert got == {("b", 0): (2, 3), ("b", 1): (1, 3), (HIDDEN, 0): (0, 3), (HIDDEN, 1): (1, 3)}


def fold_counts(df, label):
    counts = Counter((r[label], r["kfold"]) for r in df.collect())
    return [[counts[(v, f)] for f in range(5)] for v in sorted({v for v, _ in counts})]


@pytest.mark.parametrize("seed", [None, 3])
def test_stratified_folds_differ_by_at_most_one(spark, seed):
    df = spark.range(503).select("id", F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("y"))
    folds = S.stratified_kfold(df, "id", "y", 5, seed)
    per_label = fold_counts(folds, "y")
    assert all(max(c) - min(c) <= 1 for c in per_label)
    totals = [sum(c) for c in zip(*per_label)]
    assert sum(totals) == 503 and max(totals) - min(totals) <= 1


def test_folds_do_not_depend_on_the_partitioning(spark):
    df = spark.range(200).select("id", (F.col("id") % 4).cast("string").alias("y"))
    runs = [
        {r["id"]: r["kfold"] for r in S.stratified_kfold(df.repartition(n), "id", "y", 5, 7).collect()}
        for n in (1, 4, 16)
    ]
    assert runs[0] == runs[1] == runs[2]


def test_multilabel_folds_cover_every_key_once_and_balance_labels(spark):
    keys = spark.range(1000).withColumnRenamed("id", "k")
    pos = (
        keys.select("k", F.explode(F.array([F.lit(f"l{i}") for i in range(6)])).alias("label"))
        .filter(F.pmod(F.xxhash64("k", "label"), F.lit(5)) == 0)
    )
    folds = S.multilabel_stratified_kfold(keys, pos, "k", 5, 0)
    rows = folds.collect()
    assert sorted(r["k"] for r in rows) == list(range(1000))
    sizes = Counter(r["kfold"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for counts in fold_counts(pos.join(folds, "k"), "label"):
        mean = sum(counts) / 5
        assert max(abs(c - mean) for c in counts) <= 0.25 * mean


def test_split_parts_are_disjoint_and_cover(spark):
    df = spark.range(50).select("id", (F.col("id") % 5).cast("int").alias("kfold"))
    train, valid = S.train_valid_split(df, 2)
    assert train.count() == 40 and valid.count() == 10
    assert train.join(valid, "id").count() == 0


def test_holdout_keeps_the_share_in_every_stratum(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 10, "s").otherwise("big").alias("y"))
    got = Counter((r["y"], r["part"]) for r in S.holdout_split(df, "id", "y", 0.8, 1).collect())
    assert got == {("s", "train"): 8, ("s", "valid"): 2, ("big", "train"): 72, ("big", "valid"): 18}


def test_bootstrap_draws_with_replacement(spark):
    rows = [r["id"] for r in S.bootstrap_sample(spark.range(3000), 1 / 3, 5).collect()]
    assert 850 < len(rows) < 1150 and len(set(rows)) < len(rows)


def test_holdout_keeps_rows_without_stratum(spark):
    from labelloom.operators.splits import holdout_split

    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(20)], "k int, s int")
    parts = holdout_split(df, "k", "s", 0.5).toPandas()
    assert len(parts) == 20 and (parts[parts.s.isna()].part == "train").sum() == 2
