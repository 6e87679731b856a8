"""Joins: small lookups behind a size check, everything else left to Catalyst."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024


def frozen_if_small(table: DataFrame) -> DataFrame | None:
    """A local copy of ``table`` if it is within the broadcast limits, else None.

    At most ``BROADCAST_ROWS`` + 1 rows are read, so asking costs little even
    when the answer is no.
    """
    rows = table.limit(BROADCAST_ROWS + 1).toArrow()
    if rows.num_rows > BROADCAST_ROWS or rows.nbytes > BROADCAST_BYTES:
        return None
    return table.sparkSession.createDataFrame(rows, table.schema)


def lookup_join(
    df: DataFrame, table: DataFrame, on: str | Sequence[str], how: str = "left"
) -> DataFrame:
    """Join an aggregated lookup table to a large frame.

    The table is broadcast only if its measured size is within the limits;
    beyond them the join shuffles on the key, where adaptive execution splits
    skewed partitions.
    """
    small = frozen_if_small(table)
    return df.join(table if small is None else F.broadcast(small), on, how)


def group_join(df: DataFrame, table: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """As ``lookup_join`` for a table with one row per group, where the null group is a group too."""
    small = frozen_if_small(table)
    right = table if small is None else F.broadcast(small)
    right = right.withColumnsRenamed({c: f"__of_{c}" for c in by})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by])
    return df.join(right, same, how).drop(*[f"__of_{c}" for c in by])


def join_targets(
    features: DataFrame, labels: DataFrame, key: str, prefix: str = "target_"
) -> DataFrame:
    """Features left join labels; label columns get ``prefix``."""
    renamed = labels.withColumnsRenamed({c: prefix + c for c in labels.columns if c != key})
    return features.join(renamed, key, "left")


def missing_keys(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Feature keys without a label row."""
    return features.select(key).join(labels.select(key), key, "left_anti")


def concat_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of both frames side by side, matched by key instead of row order.

    A key present on one side only fails the job, whichever columns are used
    later: the check is a filter on the same join, so it costs no further pass.
    """
    r = right.withColumnRenamed(key, "__key")
    both = left.join(r, left[key] == F.col("__key"), "full_outer")
    alone = left[key].isNull() | F.col("__key").isNull()
    failed = F.raise_error(F.lit("concat_by_key: the frames do not hold the same keys")).cast("boolean")
    cols = [left[c] for c in left.columns if c != key]
    cols += [F.col(c) for c in right.columns if c != key]
    return both.filter(F.when(alone, failed).otherwise(F.lit(True))).select(left[key], *cols)


def semi_join_members(df: DataFrame, members: DataFrame, on: str) -> DataFrame:
    """Rows whose value occurs in ``members``."""
    return lookup_join(df, members.select(on).distinct(), on, "left_semi")
