"""Wide to long, long to wide, and name splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.roles import named


def melt_features(
    df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "feature", value: str = "value"
) -> DataFrame:
    """Wide columns to (ids..., feature, value)."""
    return df.unpivot([named(c) for c in ids], [named(c) for c in cols], name, value)


def melt_packed(df: DataFrame, ids: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Packed groups to (ids..., feature, value); no column per feature is planned."""
    def cells_of(group: str) -> Column:
        return F.transform(
            named(group),
            lambda v, i: F.struct(
                F.concat(F.lit(f"{group}-"), i.cast("string")).alias("feature"), v.alias("value")
            ),
        )

    parts = [cells_of(g) for g in groups]
    cells = F.concat(*parts) if len(parts) > 1 else parts[0]
    return df.select(*[named(c) for c in ids], F.inline(cells))


def melt_twice(
    df: DataFrame, ids: Sequence[str], features: Sequence[str], classes: Sequence[str]
) -> DataFrame:
    """Feature columns and class columns both turned long."""
    first = melt_features(df, [*ids, *classes], features)
    return melt_features(first, [*ids, "feature", "value"], classes, "class_name", "class_value")


def split_name(c: Column, sep: str, part: int) -> Column:
    return F.split_part(c, F.lit(sep), F.lit(part))


def split_fill_left(c: Column, sep: str, names: Sequence[str]) -> list[Column]:
    """Split into the given columns aligned to the right: short names get nulls
    on the left, surplus tokens at the end are dropped."""
    n = len(names)
    tokens = F.split(c, sep)
    kept = F.slice(tokens, 1, n)
    return [F.try_element_at(kept, F.lit(i - n)).alias(name) for i, name in enumerate(names)]


def transpose_results(long: DataFrame, row: str, col: str, value: str, cols: Sequence[str]) -> DataFrame:
    """Long results to one column per entry of ``cols``."""
    return long.groupBy(row).pivot(col, list(cols)).agg(F.first(value))
