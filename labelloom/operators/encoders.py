"""Encoders fitted on training rows and applied to any rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from labelloom.functions.arrays import let, literal, scale
from labelloom.operators.joins import lookup_join
from labelloom.operators.moments import Moments, fold_moments, moments, train_moments
from labelloom.operators.ordering import with_position
from labelloom.roles import named

MAX_LEVELS = 5_000  # an indicator column per level is only sensible for few levels


def category_levels(df: DataFrame, cols: Sequence[str]) -> dict[str, list]:
    """Sorted levels per categorical, in one pass; numbers sort as numbers."""
    text = df.select(*[named(c).cast("string").alias(c) for c in cols])
    long = text.unpivot([], [named(c) for c in cols], "column", "level")
    bound = MAX_LEVELS * len(cols)
    rows = long.filter(F.col("level").isNotNull()).distinct().limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {MAX_LEVELS} levels per column: use integer_encode or count_encode")
    out = {}
    for c in cols:
        found = [r["level"] for r in rows if r["column"] == c]
        numeric = isinstance(df.schema[c].dataType, NumericType)
        out[c] = sorted(found, key=float if numeric else None)
    return out


def one_hot(df: DataFrame, levels: dict[str, list], strict: bool = True) -> DataFrame:
    """Full indicator set ``<col>_<level>`` first, all other columns after it.

    A level that was not seen at fit time (null is none) fails the job
    (``strict``), whichever columns are used later.
    """
    flags = []
    for c, found in levels.items():
        text = named(c).cast("string")
        flags += [F.when(text == F.lit(level), 1).otherwise(0).alias(f"{c}_{level}") for level in found]
        if strict:
            shown = F.coalesce(text, F.lit("null"))
            unknown = F.raise_error(F.concat(F.lit(f"unknown level of {c}: "), shown)).cast("boolean")
            df = df.filter(F.when(text.isin(*found), F.lit(True)).otherwise(unknown))
    return df.select(*flags, *[named(c) for c in df.columns if c not in levels])


def level_codes(df: DataFrame, col: str) -> DataFrame:
    """(level, code): zero-based code per sorted level; any number of levels."""
    found = df.select(named(col).alias("level")).filter(F.col("level").isNotNull()).distinct()
    return with_position(found, ["level"], "code")


def integer_encode(df: DataFrame, codes: DataFrame, col: str, name: str) -> DataFrame:
    """Code of the level, null for a level the codes do not hold."""
    return lookup_join(
        df, codes.select(F.col("level").alias(col), F.col("code").alias(name)), col, "left"
    )


def scale_fit(df: DataFrame, column: str) -> Moments:
    return moments(df, column)


def standard_scale(df: DataFrame, column: str, fit: Moments, ddof: int = 0) -> DataFrame:
    """(x - mean) / sd per position; population sd, or sample sd with ``ddof=1``."""
    scaled = scale(named(column), fit.mean, fit.spread(ddof))
    return df.withColumn(column, scaled)


def scale_out_of_fold(df: DataFrame, column: str, fold: str = "kfold", ddof: int = 0) -> DataFrame:
    """Each row scaled with the statistics of the folds it is not in."""
    per_fold = fold_moments(df, column, fold)
    size = max(per_fold) + 1
    fits = {f: train_moments(per_fold, f) for f in per_fold}
    record = [
        {"m": fits[f].mean.tolist(), "s": fits[f].spread(ddof).tolist()} if f in fits else None
        for f in range(size)
    ]
    table = literal(record, "array<struct<m array<double>, s array<double>>>")

    def apply(p: Column) -> Column:
        centred = F.zip_with(named(column), p["m"], lambda v, m: v - m)
        return F.zip_with(centred, p["s"], lambda v, s: v / s)

    return df.withColumn(column, let(F.get(table, named(fold)), apply))


def level_counts(train: DataFrame, cols: Sequence[str]) -> dict[str, DataFrame]:
    return {
        c: train.groupBy(named(c).alias(c)).agg(F.count(F.lit(1)).alias(f"{c}_counts")) for c in cols
    }


def count_encode(df: DataFrame, train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Append ``<col>_counts``: how often the level occurs in ``train`` (null if never)."""
    counts = level_counts(train, cols)
    return reduce(lambda acc, c: lookup_join(acc, counts[c], c, "left"), cols, df)


def count_encode_out_of_fold(
    df: DataFrame, cols: Sequence[str], fold: str = "kfold"
) -> DataFrame:
    """Level counts over the other folds, from one count per (level, fold).

    The counts of the training part are total minus own fold, so no fold is
    scanned again.
    """
    out = df
    for c in cols:
        per_fold = df.groupBy(c, fold).agg(F.count(F.lit(1)).alias("__n"))
        total = per_fold.groupBy(c).agg(F.sum("__n").alias("__t"))
        train = F.col("__t") - F.col("__n")
        table = per_fold.join(total, c).select(
            c, fold, F.when(train > 0, train).alias(f"{c}_counts")
        )
        out = lookup_join(out, table, [c, fold], "left")
    return out


def assemble_vector(df: DataFrame, arrays: Sequence[str], scalars: Sequence[str] = (), name: str = "features") -> DataFrame:
    """Scalars followed by packed groups as one MLlib vector column."""
    parts = [F.array(*[named(c).cast("double") for c in scalars])] if scalars else []
    parts += [named(a) for a in arrays]
    return df.withColumn(name, array_to_vector(F.concat(*parts)))
