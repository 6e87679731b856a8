"""Label tables: sparse positives (key, label) plus an ordered vocabulary (pos, label)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.rowstats import row_argmax
from labelloom.operators.joins import lookup_join
from labelloom.roles import HIDDEN, named


def positives_from_wide(df: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """Cells equal to 1 of a wide 0/1 matrix as (key, label)."""
    long = df.unpivot([named(key)], [named(c) for c in labels], "label", "y")
    return long.filter(F.col("y") == 1).select(key, "label")


def row_label_sum(keys: DataFrame, positives: DataFrame, key: str) -> DataFrame:
    """Active labels per row, 0 for rows without any."""
    counts = positives.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return keys.select(key).join(counts, key, "left").select(
        key, F.coalesce("__n", F.lit(0)).cast("bigint").alias("label_sum")
    )


def hidden_class(
    keys: DataFrame, positives: DataFrame, key: str, skip_label: str | None = None
) -> DataFrame:
    """Keys whose labels sum to 0.

    ``skip_label`` leaves one label out of the sum (rows positive only there
    then count as hidden), the behaviour of scripts that lost their first label.
    """
    seen = positives if skip_label is None else positives.filter(F.col("label") != skip_label)
    return keys.select(key).join(seen.select(key), key, "left_anti")


def with_hidden(
    keys: DataFrame, positives: DataFrame, key: str, skip_label: str | None = None
) -> DataFrame:
    """Positives plus one (key, hidden_class) row for every row without a label."""
    seen = positives if skip_label is None else positives.filter(F.col("label") != skip_label)
    hidden = hidden_class(keys, seen, key).withColumn("label", F.lit(HIDDEN))
    return seen.select(key, "label").unionByName(hidden)


def label_totals(positives: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows per label over the whole vocabulary, zero counts included."""
    counts = positives.groupBy("label").agg(F.count(F.lit(1)).alias("__n"))
    return vocabulary.join(counts, "label", "left").select(
        *vocabulary.columns, F.coalesce("__n", F.lit(0)).cast("bigint").alias("n")
    )


def topk_classes(
    keys: DataFrame,
    positives: DataFrame,
    vocabulary: DataFrame,
    key: str,
    k: int = 12,
    hidden: bool = True,
    skip_label: str | None = None,
) -> DataFrame:
    """The k most frequent classes (k + 1 with the hidden class among the candidates).

    Ties go to the smaller vocabulary position, the hidden class last. The
    labels are gathered per key (no more than the vocabulary holds) and matched
    to the keys once, so one pass over the positives counts both the labels
    and the rows without any.
    """
    seen, words = positives, vocabulary
    if skip_label is not None:
        seen = positives.filter(F.col("label") != skip_label)
        words = vocabulary.filter(F.col("label") != skip_label)
    if not hidden:
        totals = label_totals(seen, words).select("pos", "label", "n")
        return totals.orderBy(F.col("n").desc(), "pos").limit(k)
    per_key = seen.groupBy(key).agg(F.collect_set("label").alias("labels"))
    rows = keys.select(key).join(per_key, key, "left")
    each = rows.select(F.explode(F.coalesce("labels", F.array(F.lit(HIDDEN)))).alias("label"))
    last = keys.sparkSession.createDataFrame([(2**31 - 1, HIDDEN)], "pos int, label string")
    names = words.select(F.col("pos").cast("int").alias("pos"), "label").unionByName(last)
    return label_totals(each, names).orderBy(F.col("n").desc(), "pos").limit(k + 1)


def classes_over(totals: DataFrame, minimum: int) -> DataFrame:
    """Alternative cut-off: classes with at least ``minimum`` rows."""
    return totals.filter(F.col("n") >= minimum)


def label_from_onehot(
    keys: DataFrame,
    positives: DataFrame,
    vocabulary: DataFrame,
    key: str,
    empty: str | None = "hidden",
) -> DataFrame:
    """One label per row: the first positive in vocabulary order.

    Rows without a label get the hidden class, the first label (``'first'``:
    what an argmax over zeros returns) or null.
    """
    placed = lookup_join(positives, vocabulary.select("pos", "label"), "label", "inner")
    first = placed.groupBy(key).agg(F.min_by("label", "pos").alias("__label"))
    rows = keys.select(key).join(first, key, "left")
    if empty == "first":
        default = vocabulary.agg(F.min_by("label", "pos")).scalar()
    else:
        default = F.lit(HIDDEN if empty == "hidden" else None).cast("string")
    return rows.select(key, F.coalesce(F.col("__label"), default).alias("label"))


def dense_argmax(onehot: Column, names: Sequence[str]) -> Column:
    return row_argmax(onehot, names)


def onehot_from_label(df: DataFrame, label: str, names: Sequence[str]) -> DataFrame:
    """0/1 column per vocabulary entry, in vocabulary order."""
    return df.select(
        *[named(c) for c in df.columns if c != label],
        *[F.coalesce((named(label) == F.lit(v)).cast("int"), F.lit(0)).alias(v) for v in names],
    )


def ovr_targets(
    keys: DataFrame, positives: DataFrame, key: str, classes: Sequence[str], hidden: bool = True
) -> DataFrame:
    """One 0/1 column per chosen class, from a single grouped pass over the positives."""
    flags = positives.groupBy(key).agg(
        F.count(F.lit(1)).alias("__any"),
        *[F.max((F.col("label") == c).cast("int")).alias(f"__y{i}") for i, c in enumerate(classes)],
    )
    rows = keys.select(key).join(flags, key, "left")
    cols = []
    for i, c in enumerate(classes):
        if c == HIDDEN and hidden:
            cols.append(F.col("__any").isNull().cast("int").alias(c))
        else:
            cols.append(F.coalesce(F.col(f"__y{i}"), F.lit(0)).alias(c))
    return rows.select(key, *cols)


def ovr_targets_long(wide: DataFrame, key: str, classes: Sequence[str]) -> DataFrame:
    return wide.unpivot([named(key)], [named(c) for c in classes], "class", "y")


def empty_predictions(keys: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    return keys.select(key, *[F.lit(0.0).alias(v) for v in names])


def class_balance(
    positives: DataFrame, folds: DataFrame, key: str, classes: Sequence[str]
) -> DataFrame:
    """Positives per class and fold: (kfold, n, class, positives).

    Only label rows meet the fold table, never keys x classes; pairs without
    any positive are filled in on the class x fold totals. Pass the positives
    of :func:`with_hidden` to count the hidden class.
    """
    hits = positives.join(folds, key).groupBy("kfold", F.col("label").alias("class")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    sizes = folds.groupBy("kfold").agg(F.count(F.lit(1)).alias("n"))
    cells = sizes.withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    return cells.join(hits, ["kfold", "class"], "left").select(
        "kfold", "n", "class", F.coalesce("__n", F.lit(0)).cast("bigint").alias("positives")
    )


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """Balanced weights n / (classes * n_class): (y, n_class, weight)."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n_class"))
    size = counts.agg(F.sum("n_class") / F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", size / F.col("n_class"))
