"""Frames derived from the given tables, each as Spark code and as a SQL common table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.sources.tables import scan_table

BRANDS = [f"Brand#{i}" for i in range(1, 26)]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return scan_table(spark, f"{folder}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def exact_sum(c: str) -> Column:
    """Sum of a two-decimal amount without rounding error."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def with_(*parts: str) -> str:
    return "with " + ", ".join(parts) + " "


# -- feature groups: embeddings, dimensions 1-16 as c and 17-64 as g
def features(spark, d) -> DataFrame:
    def dims(start: int, length: int) -> Column:
        return F.transform(F.slice("embedding", start, length), lambda v: v.cast("double"))

    return table(spark, d, "embeddings").select(
        "vec_id", dims(1, 16).alias("c"), dims(17, 48).alias("g"), "label"
    )


FEATURES = """features as (
  select vec_id, embedding[1:16]::double[] as c, embedding[17:64]::double[] as g, label from embeddings)"""

CELLS = """cells as (
  select vec_id, 'c' as grp, generate_subscripts(c, 1) - 1 as pos, unnest(c) as v from features
  union all
  select vec_id, 'g' as grp, generate_subscripts(g, 1) - 1 as pos, unnest(g) as v from features)"""


# -- samples: one row per order with categoricals and numeric columns
def samples(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), exact_sum("l_quantity").alias("qty")
    )
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    return (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .join(lines, "o_orderkey", "left")
        .select(
            "o_orderkey",
            "o_orderstatus",
            "o_orderpriority",
            "c_mktsegment",
            "o_totalprice",
            "c_acctbal",
            F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"),
            F.coalesce("qty", F.lit(0.0)).alias("qty"),
        )
    )


SAMPLES = """lines as (
  select l_orderkey, count(*) as n_lines, cast(sum(cast(l_quantity as decimal(18,2))) as double) as qty
  from lineitem group by l_orderkey),
samples as (
  select o_orderkey, o_orderstatus, o_orderpriority, c_mktsegment, o_totalprice, c_acctbal,
         coalesce(n_lines, 0) as n_lines, coalesce(qty, 0) as qty
  from orders join customer on o_custkey = c_custkey left join lines on l_orderkey = o_orderkey)"""


# -- positives: brands bought per order; orders without lines are the hidden rows
def positives(spark, d) -> DataFrame:
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    return (
        lines.join(part, lines["l_partkey"] == part["p_partkey"])
        .select(F.col("l_orderkey").alias("o_orderkey"), F.col("p_brand").alias("label"))
        .distinct()
    )


POSITIVES = """positives as (
  select distinct l_orderkey as o_orderkey, p_brand as label from lineitem join part on l_partkey = p_partkey)"""


def positives_fine(spark, d) -> DataFrame:
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    return (
        lines.join(part, lines["l_partkey"] == part["p_partkey"])
        .select(
            F.col("l_orderkey").alias("o_orderkey"),
            F.concat_ws("_", "p_brand", "p_type").alias("label"),
        )
        .distinct()
    )


POSITIVES_FINE = """positives_fine as (
  select distinct l_orderkey as o_orderkey, p_brand || '_' || p_type as label
  from lineitem join part on l_partkey = p_partkey)"""


def ordered_vocabulary(labels: DataFrame) -> DataFrame:
    """(pos, label) in name order; a vocabulary is as short as a list of columns."""
    names = labels.agg(F.sort_array(F.collect_set("label")).alias("names"))
    return names.select(F.posexplode("names").alias("pos", "label"))


def vocabulary(spark, d) -> DataFrame:
    return ordered_vocabulary(table(spark, d, "part").select(F.col("p_brand").alias("label")))


VOCABULARY = """vocabulary as (
  select cast(row_number() over (order by p_brand) - 1 as integer) as pos, p_brand as label
  from (select distinct p_brand from part))"""

TOPK = """hidden as (
  select o_orderkey from orders where o_orderkey not in (select o_orderkey from positives)),
totals as (
  select pos, label, coalesce(n, 0) as n from vocabulary
  left join (select label, count(*) as n from positives group by label) using (label)),
topk as (
  select pos, label, n from (
    select pos, label, n from totals
    union all select 2147483647, 'hidden_class', count(*) from hidden)
  order by n desc, pos limit 13)"""


def keys(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey")


# -- documents with two labels; documents without a label row are the unscored part
def text_features(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id",
        "lang",
        "source",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", " ")).cast("double").alias("n_words"),
    )


# -- predictions without a model: deterministic scores against known labels
def predictions(spark, d) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").select(
        "doc_id",
        "quality",
        "toxic",
        r(F.col("n_chars") % 101 / 100, 2).alias("p_toxic"),
        r((F.col("n_chars") + 37) % 101 / 100, 2).alias("p_quality"),
    )


PREDICTIONS = """predictions as (
  select doc_id, quality, toxic, round((n_chars % 101) / 100.0::double, 2) as p_toxic,
         round(((n_chars + 37) % 101) / 100.0::double, 2) as p_quality
  from documents join labels using (doc_id))"""


# -- runs: class scores of three runs, and a result table with folds
RUN_NAMES = ["baseline", "fe1", "fe2"]


def runs(spark, d) -> DataFrame:
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    run = F.when(F.col("l_returnflag") == "A", "baseline").when(
        F.col("l_returnflag") == "N", "fe1"
    ).otherwise("fe2")
    return (
        lines.join(part, lines["l_partkey"] == part["p_partkey"])
        .groupBy(run.alias("run"), F.col("p_brand").alias("class"))
        .agg((exact_sum("l_discount") / F.count(F.lit(1))).alias("score"))
    )


RUNS = """runs as (
  select case l_returnflag when 'A' then 'baseline' when 'N' then 'fe1' else 'fe2' end as run, p_brand as class,
         cast(sum(cast(l_discount as decimal(18,2))) as double) / count(*) as score
  from lineitem join part on l_partkey = p_partkey group by 1, 2)"""


def fold_scores(spark, d) -> DataFrame:
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    clf = F.when(F.col("l_returnflag") == "A", "log_reg").when(
        F.col("l_returnflag") == "N", "nb"
    ).otherwise("rf")
    return (
        lines.join(part, lines["l_partkey"] == part["p_partkey"])
        .groupBy(
            F.when(F.col("p_brand") == "Brand#1", "hidden_class").otherwise(F.col("p_brand")).alias("class"),
            clf.alias("clf"),
            F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("ordinal"),
            F.concat(F.lit("C="), F.col("l_linestatus")).alias("params"),
            (F.col("l_linenumber") % 5).alias("fold"),
        )
        .agg((exact_sum("l_discount") / F.count(F.lit(1))).alias("score"))
    )


FOLD_SCORES = """fold_scores as (
  select case when p_brand = 'Brand#1' then 'hidden_class' else p_brand end as class,
         case l_returnflag when 'A' then 'log_reg' when 'N' then 'nb' else 'rf' end as clf,
         case when l_linestatus = 'O' then 0 else 1 end as ordinal, 'C=' || l_linestatus as params,
         l_linenumber % 5 as fold, cast(sum(cast(l_discount as decimal(18,2))) as double) / count(*) as score
  from lineitem join part on l_partkey = p_partkey group by 1, 2, 3, 4, 5)""".strip()

MEANS = """means as (
  select class, clf, ordinal, params, avg(score) as mean_score from fold_scores group by 1, 2, 3, 4)"""

# -- folds of the feature rows, stratified on the label, in key order
FOLDS = """folds as (
  select vec_id, cast((row_number() over (order by label, vec_id) - 1) % 5 as integer) as kfold from embeddings)"""
