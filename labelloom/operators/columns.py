"""Column selection, renaming, relabelling and row filters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.roles import named


def select_prefix(df: DataFrame, prefix: str, keep: Sequence[str] = (), anywhere: bool = False) -> DataFrame:
    """Columns whose name starts with (or holds) ``prefix``, after ``keep``."""
    hits = [c for c in df.columns if (prefix in c if anywhere else c.startswith(prefix))]
    return df.select(*[named(c) for c in (*keep, *[h for h in hits if h not in keep])])


def select_num_range(df: DataFrame, prefix: str, numbers: Iterable[int], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[named(c) for c in keep], *[named(f"{prefix}{n}") for n in numbers])


def select_positions(df: DataFrame, start: int, stop: int, keep: Sequence[str] = ()) -> DataFrame:
    """Columns at 0-based positions [start, stop), after ``keep``."""
    return df.select(*[named(c) for c in keep], *[named(c) for c in df.columns[start:stop]])


def drop_key(df: DataFrame, key: str) -> DataFrame:
    return df.drop(key)


def clean_names(df: DataFrame) -> DataFrame:
    """Dashes and blanks to underscores, lower case."""
    new = {c: c.replace("-", "_").replace(" ", "_").lower() for c in df.columns}
    return df.withColumnsRenamed({a: b for a, b in new.items() if a != b})


def add_prefix(df: DataFrame, prefix: str, key: str) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c != key})


def strip_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: c.removeprefix(prefix) for c in df.columns if c.startswith(prefix)})


def filter_eq(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(named(column) == F.lit(value))


def filter_below(df: DataFrame, column: str, limit: float) -> DataFrame:
    return df.filter(named(column) < F.lit(limit))


def bucket_tail(n: Column, limit: int = 3) -> Column:
    """Counts as text, everything from ``limit`` on as ``"<limit>+"``."""
    return F.when(n >= limit, F.lit(f"{limit}+")).otherwise(n.cast("string"))


def relabel(c: Column, value: str, yes: str, no: str) -> Column:
    return F.when(c == F.lit(value), F.lit(yes)).otherwise(F.lit(no))


def replace_value(c: Column, old, new) -> Column:
    return F.when(c == F.lit(old), F.lit(new)).otherwise(c)


def combine_categories(cols: Sequence[str]) -> Column:
    """Levels of several categoricals joined by underscores into one text level."""
    return F.concat_ws("_", *[named(c).cast("string") for c in cols])


def zero_rows_where(df: DataFrame, condition: Column, cols: Sequence[str]) -> DataFrame:
    """Set the listed prediction columns to 0 on rows that meet the condition."""
    return df.withColumns({c: F.when(condition, F.lit(0.0)).otherwise(named(c)) for c in cols})


def duration_label(c: Column) -> Column:
    return F.concat(F.lit("Duration "), c.cast("string"), F.lit("h"))


def percent_label(share: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", share * 100)


def spaced(c: Column) -> Column:
    return F.regexp_replace(c, "_", " ")


def log10_count(c: Column) -> Column:
    """log10; a count of zero gives null instead of minus infinity."""
    return F.when(c > 0, F.log10(c))


def log1p_count(c: Column) -> Column:
    return F.log1p(c)


def as_category(c: Column) -> Column:
    return c.cast("string")
