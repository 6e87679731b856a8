"""Folds, hold-out and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators.joins import lookup_join
from labelloom.operators.ordering import with_position


def _tie(key: str, seed: int | None) -> Column:
    """Order inside a stratum: by key, or by a seeded hash of it."""
    return F.lit(0) if seed is None else F.xxhash64(F.lit(seed), F.col(key))


def train_valid_split(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col("kfold") != fold), df.filter(F.col("kfold") == fold)


def stratified_kfold(
    df: DataFrame, key: str, label: str, k: int = 5, seed: int | None = None
) -> DataFrame:
    """(key, label, kfold): position in the order (label, hash, key) modulo k.

    Fold counts differ by at most one for every label and in total. A label
    with most of the rows is still split over slices, because the order ends
    in the key.
    """
    rows = df.select(key, label, _tie(key, seed).alias("__h"))
    placed = with_position(rows, [label, "__h", key], "__pos")
    return placed.select(key, label, (F.col("__pos") % k).cast("int").alias("kfold"))


def multilabel_stratified_kfold(
    keys: DataFrame, positives: DataFrame, key: str, k: int = 5, seed: int | None = None
) -> DataFrame:
    """(key, kfold) balanced on every label.

    Rows are grouped by their globally rarest label (rows without labels form
    their own stratum), ordered by label signature inside it and dealt to the
    folds in turn. Signatures are as long as the row's label list; the label
    counts are the only broadcast table.
    """
    counts = positives.groupBy("label").agg(F.count(F.lit(1)).alias("__n"))
    counted = lookup_join(positives.select(key, "label"), counts, "label", "inner")
    per_row = counted.groupBy(key).agg(
        F.min(F.struct("__n", "label")).getField("label").alias("stratum"),
        F.concat_ws(",", F.sort_array(F.collect_set("label"))).alias("signature"),
    )
    rows = keys.select(key).join(per_row, key, "left").select(
        key,
        F.coalesce("stratum", F.lit("")).alias("stratum"),
        F.coalesce("signature", F.lit("")).alias("signature"),
        _tie(key, seed).alias("__h"),
    )
    placed = with_position(rows, ["stratum", "signature", "__h", key], "__pos")
    return placed.select(key, (F.col("__pos") % k).cast("int").alias("kfold"))


def holdout_split(
    df: DataFrame, key: str, strata: str, share: float = 0.8, seed: int | None = None
) -> DataFrame:
    """(key, strata, part): the first ``share`` of every stratum is training; null is a stratum too."""
    rows = df.select(key, strata, _tie(key, seed).alias("__h"))
    placed = with_position(rows, [strata, "__h", key], "__pos")
    bounds = placed.groupBy(F.col(strata).alias("__stratum")).agg(
        F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    joined = placed.join(bounds, F.col(strata).eqNullSafe(F.col("__stratum")))
    rank = F.col("__pos") - F.col("__first") + 1
    return joined.select(
        key, strata, F.when(rank <= F.lit(share) * F.col("__n"), "train").otherwise("valid").alias("part")
    )


def bootstrap_sample(df: DataFrame, share: float = 1 / 3, seed: int = 0) -> DataFrame:
    """Rows drawn with replacement."""
    return df.sample(withReplacement=True, fraction=share, seed=seed)
