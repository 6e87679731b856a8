"""Statistics of one array per row: 13 of them, alone or together.

Each is a Column -> Column builder over the sorted array, so a row is sorted
once however many statistics are asked for, and no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.arrays import let, total
from labelloom.roles import named


def _at(s: Column, q: float) -> Column:
    """Quantile with linear interpolation between the neighbouring ranks."""
    h = (F.size(s) - 1) * F.lit(float(q))
    low = F.get(s, F.floor(h).cast("int"))
    high = F.get(s, F.ceil(h).cast("int"))
    return low + (high - low) * (h - F.floor(h))


def _variance(s: Column) -> Column:
    return let(
        total(s) / F.size(s),
        lambda m: F.aggregate(s, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.size(s),
    )


# fixed values: the statistics in the order the feature step lists them
STATS = {
    "min": lambda s: F.get(s, F.lit(0)),
    "max": lambda s: F.get(s, F.size(s) - 1),
    "sum": total,
    "mean": lambda s: total(s) / F.size(s),
    "std": lambda s: F.sqrt(_variance(s)),
    "var": _variance,
    "range": lambda s: F.get(s, F.size(s) - 1) - F.get(s, F.lit(0)),
    "p10": lambda s: _at(s, 0.10),
    "p60": lambda s: _at(s, 0.60),
    "p90": lambda s: _at(s, 0.90),
    "p5": lambda s: _at(s, 0.05),
    "p95": lambda s: _at(s, 0.95),
    "p99": lambda s: _at(s, 0.99),
}

ORDER_FREE = {"sum", "mean", "std", "var"}  # no sort needed


def row_stat(x: Column, stat: str) -> Column:
    build = STATS[stat]
    if stat == "min":
        return F.array_min(x)
    if stat == "max":
        return F.array_max(x)
    if stat == "range":
        return F.array_max(x) - F.array_min(x)
    return build(x) if stat in ORDER_FREE else let(F.sort_array(x), build)


def row_stats(
    df: DataFrame,
    groups: Sequence[str],
    stats: Sequence[str] | Mapping[str, Callable[[Column], Column]] = tuple(STATS),
) -> DataFrame:
    """Append ``<group>_<stat>`` columns, groups in the given order.

    ``stats`` are names of the statistics above, or own builders by name; a
    builder gets the sorted array.
    """
    builders = stats if isinstance(stats, Mapping) else {n: STATS[n] for n in stats}
    packed = df
    for g in groups:
        bundle = let(
            F.sort_array(named(g)), lambda s: F.struct(*[f(s).alias(n) for n, f in builders.items()])
        )
        packed = packed.withColumn(f"__{g}", bundle)
    flat = [F.col(f"__{g}").getField(n).alias(f"{g}_{n}") for g in groups for n in builders]
    return packed.select(*[named(c) for c in df.columns], *flat)


def row_argmax(p: Column, names: Sequence[str]) -> Column:
    """Name of the largest entry, the first one on ties; NaN never wins."""
    clean = F.transform(p, lambda v: F.nanvl(v, F.lit(float("-inf"))))
    pos = let(clean, lambda a: F.array_position(a, F.array_max(a)))
    return F.get(F.array(*[F.lit(n) for n in names]), (pos - 1).cast("int"))


def keep_argmax(p: Column) -> Column:
    """Zero every entry but the largest (first on ties)."""
    clean = F.transform(p, lambda v: F.nanvl(v, F.lit(float("-inf"))))
    best = let(clean, lambda a: F.array_position(a, F.array_max(a)))
    return let(
        best, lambda b: F.transform(p, lambda v, i: F.when(i + 1 == b, v).otherwise(F.lit(0.0)))
    )
