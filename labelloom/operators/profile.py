"""Counts, shares, column statistics and quality checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from labelloom.functions.binomial import bounds_udf
from labelloom.operators.joins import group_join, lookup_join
from labelloom.operators.ordering import quantiles
from labelloom.roles import named


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per level of each column, most frequent first: (column, level, n)."""
    text = df.select(*[named(c).cast("string").alias(c) for c in cols])
    long = text.unpivot([], [named(c) for c in cols], "column", "level")
    counts = long.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy("column", F.col("n").desc(), "level")


def count_share(df: DataFrame, col: str) -> DataFrame:
    """Count per level with the table total and the share."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()  # reuses the shuffle of the counts
    return counts.withColumn("total", total).withColumn("perc", F.col("n") / F.col("total"))


def count_share_within(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Count per (outer, inner) and its share of the outer level.

    The window runs over the aggregated counts, one row per pair of levels.
    """
    counts = df.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn(
        "total", F.sum("n").over(Window.partitionBy(outer))
    ).withColumn("perc", F.col("n") / F.col("total"))


def group_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def count_band(df: DataFrame, col: str, low: int | None, high: int | None) -> DataFrame:
    """Rows whose level occurs at least ``low`` and fewer than ``high`` times."""
    levels = df.groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    if low is not None:
        levels = levels.filter(F.col("__n") >= low)
    if high is not None:
        levels = levels.filter(F.col("__n") < high)
    return lookup_join(df, levels.select(col), col, "left_semi")


def column_stats(df: DataFrame, group: str, prefix: str | None = None) -> DataFrame:
    """min / max / mean / sample sd of every position of a packed group, long.

    One pass with vector-valued partial aggregates: a task sends one buffer per
    group, not one row per cell.
    """
    stats = Summarizer.metrics("min", "max", "mean", "std")
    vec = array_to_vector(named(group))
    row = df.filter(named(group).isNotNull()).select(stats.summary(vec).alias("s"))
    arrays = [vector_to_array(F.col(f"s.{n}")).alias(n) for n in ("min", "max", "mean", "std")]
    cells = row.select(F.posexplode(F.arrays_zip(*arrays)).alias("pos", "v"))
    wide = cells.select(
        F.concat(F.lit(f"{prefix or group}-"), F.col("pos").cast("string")).alias("feature"),
        F.col("v.min").alias("min"),
        F.col("v.max").alias("max"),
        F.col("v.mean").alias("mean"),
        F.col("v.std").alias("sd"),
    )
    return wide.unpivot("feature", ["min", "max", "mean", "sd"], "stat", "value")


def column_aggregates(
    df: DataFrame, cols: Sequence[str], aggs: Mapping[str, Callable[[Column], Column]]
) -> DataFrame:
    """Any aggregate functions over any columns in one pass: (feature, stat, value)."""
    cells = [
        F.struct(
            F.lit(c).alias("feature"), F.lit(name).alias("stat"), fn(named(c)).cast("double").alias("value")
        )
        for c in cols
        for name, fn in aggs.items()
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def describe(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """count, mean, std, min, exact quartiles and max per group."""
    basic = df.groupBy(*by).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    quart = quantiles(df, by, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return group_join(basic, quart, by) if by else basic.crossJoin(quart)  # one row each


def constant_check(df: DataFrame, group: str) -> DataFrame:
    """Smallest standard deviation over all columns and the number of constant ones."""
    sd = column_stats(df, group).filter(F.col("stat") == "sd")
    return sd.agg(
        F.min("value").alias("min_sd"),
        F.sum((F.col("value") == 0).cast("bigint")).alias("constant_columns"),
    )


def null_count(df: DataFrame) -> DataFrame:
    """Missing cells of the whole table, those inside arrays included, in one pass over all columns."""

    def missing(field: T.StructField) -> Column:
        c = named(field.name)
        inside = F.lit(0)
        if isinstance(field.dataType, T.ArrayType):
            inside = F.size(F.filter(c, lambda x: x.isNull()))
        return F.when(c.isNull(), F.lit(1)).otherwise(inside).cast("bigint")

    # an array keeps the expression flat, however many columns there are
    per_row = F.aggregate(F.array(*map(missing, df.schema.fields)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return df.agg(F.sum(per_row).alias("null_cells"))


def label_density(keys: DataFrame, positives: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Percentage of ones in the rows x labels matrix, from its sparse form."""
    rows = keys.agg(F.count(F.lit(1))).scalar()
    labels = vocabulary.agg(F.count(F.lit(1))).scalar()
    return positives.agg(F.count(F.lit(1)).alias("ones")).select(
        "ones", (F.col("ones") / (rows * labels) * 100).alias("density_percent")
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows minus distinct keys; partial counts per key absorb a frequent key."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return per_key.agg((F.sum("__n") - F.count(F.lit(1))).alias("duplicates"))


def distinct_labels(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().agg(F.count(F.lit(1)).alias("n_labels"))


def table_shape(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, n_rows, n_columns) for each table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def labels_per_row_hist(label_sums: DataFrame, col: str = "label_sum") -> DataFrame:
    return count_share(label_sums, col)


def suffix_counts(labels: DataFrame, col: str = "label") -> DataFrame:
    """Last underscore token of the label names; the share is taken before n > 1."""
    suffix = labels.select(F.split_part(F.col(col), F.lit("_"), F.lit(-1)).alias("suffix"))
    return count_share(suffix, "suffix").filter(F.col("n") > 1)


def top_n(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(by).desc(), tie).limit(n)


def bottom_n(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(by).asc(), tie).limit(n)


def reorder_levels(df: DataFrame, level: str, value: str) -> DataFrame:
    """Levels ordered by their smallest value."""
    return df.groupBy(level).agg(F.min(value).alias("order_value")).orderBy("order_value", level)


def pair_fit(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Correlation and least-squares line of y on x for each pair, in one pass."""
    aggs = []
    for i, (x, y) in enumerate(pairs):
        a, b = named(x), named(y)
        aggs.append(
            F.struct(
                F.lit(x).alias("x"),
                F.lit(y).alias("y"),
                F.corr(a, b).alias("corr"),
                F.regr_slope(b, a).alias("slope"),
                F.regr_intercept(b, a).alias("intercept"),
                F.regr_r2(b, a).alias("r2"),
            ).alias(f"p{i}")
        )
    row = df.agg(*aggs)
    return row.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])))


def proportion_ci(df: DataFrame, by: Sequence[str], hit: str, level: float = 0.95) -> DataFrame:
    """Exact (Clopper-Pearson) bounds for the share of ``hit`` = 1 per group.

    The counts are aggregated in Spark; only one row per group reaches Python.
    """
    counts = df.groupBy(*by).agg(
        F.sum(F.col(hit).cast("bigint")).alias("x"), F.count(hit).alias("n")
    )
    lower, upper = bounds_udf(level)
    return counts.withColumns({"lwr": lower("x", "n"), "upr": upper("x", "n")})


def conformance_check(output: DataFrame, template: DataFrame, key: str) -> DataFrame:
    """Same shape, same keys, same column names: one row of booleans."""
    marked = (
        output.select(key, F.lit(1).alias("o"), F.lit(0).alias("t"))
        .unionByName(template.select(key, F.lit(0).alias("o"), F.lit(1).alias("t")))
        .groupBy(key)
        .agg(F.sum("o").alias("o"), F.sum("t").alias("t"))
    )
    same_columns = output.columns == template.columns
    return marked.agg(
        (F.sum("o") == F.sum("t")).alias("rows_equal"),
        F.min((F.col("o") == F.col("t")).cast("int")).cast("boolean").alias("keys_equal"),
    ).select(
        (F.col("rows_equal") & F.lit(len(output.columns) == len(template.columns))).alias("same_shape"),
        F.col("keys_equal").alias("same_keys"),
        F.lit(same_columns).alias("same_columns"),
    )


def label_gap(train: DataFrame, valid: DataFrame, label: str) -> DataFrame:
    """Labels present on one side only: (label, missing_in)."""
    a, b = train.select(label).distinct(), valid.select(label).distinct()
    return (
        a.join(b, label, "left_anti")
        .withColumn("missing_in", F.lit("valid"))
        .unionByName(b.join(a, label, "left_anti").withColumn("missing_in", F.lit("train")))
    )
