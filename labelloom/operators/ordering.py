"""Positions, running totals and exact quantiles over a distributed order.

A window without partitions would pull the whole table into one task. Here the
rows are range-partitioned and sorted, numbered inside their slice, and only
one row per slice (its size) is combined to get the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelloom.operators.joins import group_join
from labelloom.session import settle

SLOT_BITS = 33  # monotonically_increasing_id: slice number above, row number below


def sorted_slices(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Globally sorted copy with ``__slice`` and ``__row`` (0-based inside the slice).

    End the order with a unique column: a value shared by many rows can then
    be split over slices. The result is settled, because range boundaries are
    sampled again whenever the plan runs again.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    slot = settle(ranged.withColumn("__slot", F.monotonically_increasing_id()))
    return slot.select(
        *df.columns,
        F.shiftright("__slot", SLOT_BITS).alias("__slice"),
        F.col("__slot").bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).alias("__row"),
    )


def _offsets(per_slice: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sum of all earlier slices; the window runs over one row per slice."""
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(
        "__slice", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__before_{c}") for c in cols]
    )


def with_position(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Append the 0-based position in ``order``."""
    sliced = sorted_slices(df, order)
    sizes = sliced.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n"))
    joined = sliced.join(F.broadcast(_offsets(sizes, ["__n"])), "__slice")  # one row per partition
    return joined.select(*df.columns, (F.col("__before___n") + F.col("__row")).alias(name))


def running_total(df: DataFrame, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Append ``cum_<col>``: the sum over all rows up to and including this one."""
    sliced = sorted_slices(df, order)
    sums = sliced.groupBy("__slice").agg(*[F.sum(c).alias(c) for c in cols])
    inside = Window.partitionBy("__slice").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select("*", *[F.sum(c).over(inside).alias(f"__in_{c}") for c in cols])
    joined = local.join(F.broadcast(_offsets(sums, cols)), "__slice")
    return joined.select(
        *df.columns,
        *[(F.col(f"__before_{c}") + F.col(f"__in_{c}")).alias(f"cum_{c}") for c in cols],
    )


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group: (by..., name...).

    Equal values are merged before the sort, so neither a frequent value nor a
    dominant group ends up whole in one task.
    """
    keys = list(by) or ["__all"]
    base = df if by else df.withColumn("__all", F.lit(0))
    counts = (
        base.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("__cnt"))
    )
    ranked = running_total(counts, [*keys, value], ["__cnt"])
    first = F.col("cum___cnt") - F.col("__cnt")
    groups = ranked.groupBy(*keys).agg(F.min(first).alias("__start"), F.sum("__cnt").alias("__total"))
    inside = group_join(ranked, groups, keys, "inner")
    low_rank = first - F.col("__start")
    high_rank = F.col("cum___cnt") - F.col("__start") - 1

    def pick(rank: Column) -> Column:
        return F.max(F.when(rank.between(low_rank, high_rank), F.col(value)))

    aggs = [F.max("__total").alias("__total")]
    for name, q in probs.items():
        h = (F.col("__total") - 1) * F.lit(float(q))
        aggs += [pick(F.floor(h)).alias(f"__lo_{name}"), pick(F.ceil(h)).alias(f"__hi_{name}")]
    picked = inside.groupBy(*keys).agg(*aggs)
    out = []
    for name, q in probs.items():
        h = (F.col("__total") - 1) * F.lit(float(q))
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return picked.select(*by, *out)


def shuffle_rows(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Seeded random permutation; the same seed gives the same order."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key))


def add_row_index(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    return with_position(df, order, name)


def row_batches(df: DataFrame, order: Sequence[str], size: int, name: str = "batch") -> DataFrame:
    """Consecutive chunks of ``size`` rows as a batch number, without a loop."""
    pos = with_position(df, order, "__pos")
    return pos.withColumn(name, F.floor(F.col("__pos") / size)).drop("__pos")


def head_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)


def tail_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(F.col(key).desc()).limit(n)
