"""Sources, column operators and joins on the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.operators import columns as C
from labelloom.operators import joins as J
from labelloom.operators import profile as P
from labelloom.operators import targets as T
from labelloom.operators.encoders import assemble_vector, level_counts
from labelloom.operators.ordering import add_row_index, head_rows, tail_rows
from labelloom.operators.reshape import melt_packed
from labelloom.operators.results import align_runs, result_cell, tuned_strength
from labelloom.operators.splits import stratified_kfold
from labelloom.models.linear import logistic
from labelloom.models.ovr import in_pool
from labelloom.queries.frames import (
    CELLS,
    FEATURES,
    FOLDS,
    POSITIVES,
    POSITIVES_FINE,
    RUN_NAMES,
    RUNS,
    SAMPLES,
    features,
    keys,
    positives,
    positives_fine,
    r,
    runs,
    samples,
    table,
    with_,
)
from labelloom.queries.logistic import logistic_sql, proba
from labelloom.queries.registry import query
from labelloom.roles import unpack
from labelloom.session import scratch_path
from labelloom.sources.sinks import load_model, read_results, save_model, write_csv, write_results
from labelloom.sources.tables import Catalog, scan_table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


# ---- sources and sinks
@query(
    "scan_table",
    "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as order_day, "
    "o_orderpriority from orders",
)
def _(spark, d):
    return scan_table(spark, f"{d}/orders.parquet").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_totalprice",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"),
        "o_orderpriority",
    )


@query("drop_key", "select o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def _(spark, d):
    return C.drop_key(table(spark, d, "orders").drop("o_orderdate"), "o_orderkey")


@query(
    "sink_csv",
    with_(SAMPLES) + "select o_orderkey, o_orderstatus, o_totalprice, c_acctbal, n_lines, qty from samples",
)
def _(spark, d):
    df = samples(spark, d).select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "c_acctbal", "n_lines", "qty"
    )
    path = write_csv(df, scratch_path(spark, "csv"))
    return scan_table(spark, path, df.schema)


@query(
    "sink_results",
    with_(RUNS) + "select run, class, score from runs where run = 'fe1'",
)
def _(spark, d):
    path = write_results(runs(spark, d), scratch_path(spark, "results"))
    return read_results(spark, path).filter(F.col("run") == "fe1").select("run", "class", "score")


CELL_SQL = """
cells_text as (
  select p_brand as class_name, '[(''l2'', ' || cast(case count(*) % 4 when 0 then 0.01 when 1 then 0.1 when 2 then 1.5
         else 100.25 end as varchar) || '), ' || cast(round(avg(l_discount), 4) as varchar) || ']' as cell
  from lineitem join part on l_partkey = p_partkey group by p_brand)"""


@query(
    "read_tuned_params",
    with_(CELL_SQL.strip())
    + r"select class_name, cast(regexp_extract(cell, ', ([0-9.e-]+)\)', 1) as double) as strength from cells_text",
)
def _(spark, d):
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    n = F.count(F.lit(1))
    strength = F.when(n % 4 == 0, 0.01).when(n % 4 == 1, 0.1).when(n % 4 == 2, 1.5).otherwise(100.25)
    cells = (
        lines.join(part, lines["l_partkey"] == part["p_partkey"])
        .groupBy(F.col("p_brand").alias("class_name"))
        .agg(strength.alias("c"), r(F.avg("l_discount"), 4).alias("s"))
        .select("class_name", result_cell(F.lit("l2"), F.col("c"), F.col("s")).alias("cell"))
    )
    return cells.select("class_name", tuned_strength(F.col("cell")).alias("strength"))


@query(
    "model_store",
    "with recursive "
    + ", ".join(
        [
            FEATURES,
            FOLDS,
            "embedded as materialized (select vec_id, kfold, (label = 0)::int as y, list_concat(c, g, [1.0::double]) as x "
            "from features join folds using (vec_id))",
            "strength as (select f as model, 1.0::double as c from range(5) t(f))",
            "train as materialized (select model, x, y from embedded join strength on kfold <> model)",
            logistic_sql(64, 80),
        ]
    )
    + f"select vec_id, kfold, (list_dot_product(w, x) > 0)::int::double as prediction, round({proba('w', 'x')}, 4) as p "
    "from embedded join weights on model = kfold",
)
def _(spark, d):
    from pyspark.ml import Pipeline

    rows = features(spark, d).join(
        stratified_kfold(features(spark, d), "vec_id", "label").select("vec_id", "kfold"), "vec_id"
    )
    rows = assemble_vector(rows, ["c", "g"]).withColumn("y", (F.col("label") == 0).cast("double"))
    rows = rows.select("vec_id", "kfold", "y", "features").persist()
    path = scratch_path(spark, "models")

    def one_fold(fold: int):
        train = rows.filter(F.col("kfold") != fold)
        save_model(Pipeline(stages=[logistic(1.0, train.count(), tol=1e-9)]).fit(train), path, fold)
        scored = load_model(path, fold).transform(rows.filter(F.col("kfold") == fold))
        p = vector_to_array("probability")[1]
        return scored.select("vec_id", "kfold", "prediction", r(p, 4).alias("p"))

    parts = in_pool(spark, [lambda f=f: one_fold(f) for f in range(5)])
    return reduce(DataFrame.unionByName, parts)


@query(
    "preview",
    "(select 'head' as part, o_orderkey, o_totalprice from orders order by o_orderkey limit 10) union all "
    "(select 'tail' as part, o_orderkey, o_totalprice from orders order by o_orderkey desc limit 10)",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    head = head_rows(rows, "o_orderkey", 10).withColumn("part", F.lit("head"))
    tail = tail_rows(rows, "o_orderkey", 10).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


@query(
    "table_catalog",
    " union all ".join(f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in TABLES),
)
def _(spark, d):
    Catalog(spark, {t: f"{d}/{t}.parquet" for t in TABLES}).register()
    parts = [f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES]
    return spark.sql(" UNION ALL ".join(parts))


# ---- columns
def wide_features(spark, d):
    return unpack(features(spark, d), {"c": 16, "g": 48})


def _cols(group, numbers, alias="{g}-{i}"):
    return ", ".join(f'{group}[{i + 1}] as "{alias.format(g=group, i=i)}"' for i in numbers)


@query("select_prefix", with_(FEATURES) + f"select vec_id, {_cols('c', range(16))} from features")
def _(spark, d):
    return C.select_prefix(wide_features(spark, d), "c-", keep=["vec_id"])


@query(
    "select_num_range",
    with_(FEATURES) + f"select vec_id, label, {_cols('g', [8, 25])}, {_cols('c', [14, 2])} from features",
)
def _(spark, d):
    w = wide_features(spark, d)
    g = C.select_num_range(w, "g-", [8, 25], keep=["vec_id", "label"])
    return J.concat_by_key(g, C.select_num_range(w, "c-", [14, 2], keep=["vec_id"]), "vec_id")


@query("select_positions", with_(FEATURES) + f"select vec_id, {_cols('c', range(3, 8))} from features")
def _(spark, d):
    w = C.select_prefix(wide_features(spark, d), "c-", keep=["vec_id"])
    return C.select_positions(w, 4, 9, keep=["vec_id"])


@query(
    "rename_columns",
    with_(FEATURES) + f"select vec_id, {_cols('c', range(16), 'feature_{g}_{i}')} from features",
)
def _(spark, d):
    w = C.select_prefix(wide_features(spark, d), "c-", keep=["vec_id"])
    twice = C.add_prefix(C.clean_names(w), "x_feature_", "vec_id")
    return C.strip_prefix(twice, "x_")


@query("filter_eq", "select o_orderkey, o_orderstatus from orders where o_orderstatus = 'O'")
def _(spark, d):
    return C.filter_eq(
        table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "O"
    )


@query(
    "filter_threshold",
    with_(FEATURES, CELLS)
    + "select vec_id, grp || '-' || pos as feature, v as value from cells where v < -0.3",
)
def _(spark, d):
    return C.filter_below(melt_packed(features(spark, d), ["vec_id"], ["c", "g"]), "value", -0.3)


@query(
    "filter_count_band",
    with_(POSITIVES_FINE)
    + "select o_orderkey, label from positives_fine where label in "
    "(select label from positives_fine group by label having count(*) >= 100 and count(*) < 300)",
)
def _(spark, d):
    return P.count_band(positives_fine(spark, d), "label", 100, 300)


LABEL_SUMS = """label_sums as (
  select o.o_orderkey, count(p.label) as label_sum from orders o left join positives p using (o_orderkey) group by 1)"""


@query(
    "bucket_tail",
    with_(POSITIVES, LABEL_SUMS)
    + "select o_orderkey, case when label_sum >= 3 then '3+' else cast(label_sum as varchar) end as bucket from label_sums",
)
def _(spark, d):
    sums = T.row_label_sum(keys(spark, d), positives(spark, d), "o_orderkey")
    return sums.select("o_orderkey", C.bucket_tail(F.col("label_sum")).alias("bucket"))


@query(
    "relabel",
    "select o_orderkey, case when o_orderstatus = 'O' then 'Open order' else 'Closed order' end as status from orders",
)
def _(spark, d):
    status = C.relabel(F.col("o_orderstatus"), "O", "Open order", "Closed order")
    return table(spark, d, "orders").select("o_orderkey", status.alias("status"))


@query(
    "replace_value",
    "select doc_id, case when quality = 1 then 0 else quality end as quality_zeroed, nullif(toxic, 1)::double as toxic_na from labels",
)
def _(spark, d):
    return table(spark, d, "labels").select(
        "doc_id",
        C.replace_value(F.col("quality"), 1, 0).alias("quality_zeroed"),
        F.nullif(F.col("toxic"), F.lit(1)).cast("double").alias("toxic_na"),
    )


@query(
    "combine_categories",
    with_(SAMPLES)
    + "select o_orderkey, o_orderstatus || '_' || o_orderpriority || '_' || c_mktsegment as combined from samples",
)
def _(spark, d):
    cats = ["o_orderstatus", "o_orderpriority", "c_mktsegment"]
    return samples(spark, d).select("o_orderkey", C.combine_categories(cats).alias("combined"))


@query(
    "zero_rows_where",
    "select doc_id, case when lang = 'de' then 0.0::double else quality::double end as quality, "
    "case when lang = 'de' then 0.0::double else toxic::double end as toxic from documents join labels using (doc_id)",
)
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    rows = rows.withColumns({c: F.col(c).cast("double") for c in ("quality", "toxic")})
    return C.zero_rows_where(rows, F.col("lang") == "de", ["quality", "toxic"]).drop("lang")


@query(
    "format_labels",
    with_(POSITIVES_FINE)
    + "select label, replace(label, '_', ' ') as spaced, 'Duration ' || count(*) || 'h' as duration, "
    "printf('%.2f%%', 100.0 * count(*) / (select count(*) from positives_fine)) as percent from positives_fine group by label",
)
def _(spark, d):
    counts = P.count_share(positives_fine(spark, d), "label")
    return counts.select(
        "label",
        C.spaced(F.col("label")).alias("spaced"),
        C.duration_label(F.col("n")).alias("duration"),
        C.percent_label(F.col("perc")).alias("percent"),
    )


@query(
    "log_scale",
    with_(POSITIVES_FINE)
    + "select label, round(log10(count(*)), 9) as log10_n, round(ln(1 + count(*)), 9) as log1p_n from positives_fine group by label",
)
def _(spark, d):
    n = positives_fine(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.select(
        "label",
        r(C.log10_count(F.col("n")), 9).alias("log10_n"),
        r(C.log1p_count(F.col("n")), 9).alias("log1p_n"),
    )


@query(
    "add_row_index",
    "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as row_index, -1 as kfold from orders",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    indexed = add_row_index(rows, ["o_orderdate", "o_orderkey"])
    return indexed.select("o_orderkey", "row_index", F.lit(-1).alias("kfold"))


@query("cast_category", "select c_custkey, cast(c_nationkey as varchar) as nation from customer")
def _(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", C.as_category(F.col("c_nationkey")).alias("nation")
    )


# ---- joins
@query(
    "join_targets",
    "select d.doc_id, lang, source, n_chars, quality::double as target_quality, toxic::double as target_toxic "
    "from documents d left join labels using (doc_id)",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    joined = J.join_targets(docs, table(spark, d, "labels"), "doc_id")
    return joined.withColumns({c: F.col(c).cast("double") for c in ("target_quality", "target_toxic")})


@query(
    "anti_join_missing",
    "select count(*) as n_missing from documents where doc_id not in (select doc_id from labels)",
)
def _(spark, d):
    missing = J.missing_keys(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")
    return missing.agg(F.count(F.lit(1)).alias("n_missing"))


@query(
    "positional_concat",
    with_(SAMPLES, POSITIVES, LABEL_SUMS)
    + "select o_orderkey, o_orderstatus, o_totalprice, label_sum from samples join label_sums using (o_orderkey)",
)
def _(spark, d):
    left = samples(spark, d).select("o_orderkey", "o_orderstatus", "o_totalprice")
    sums = T.row_label_sum(keys(spark, d), positives(spark, d), "o_orderkey")
    return J.concat_by_key(left, sums, "o_orderkey")


@query(
    "lookup_map",
    with_(SAMPLES)
    + "select o_orderkey, c_mktsegment, n as c_mktsegment_counts from samples join "
    "(select c_mktsegment, count(*) as n from samples where o_orderstatus = 'F' group by 1) using (c_mktsegment)",
)
def _(spark, d):
    rows = samples(spark, d).select("o_orderkey", "c_mktsegment", "o_orderstatus")
    counts = level_counts(C.filter_eq(rows, "o_orderstatus", "F"), ["c_mktsegment"])
    return J.lookup_join(rows.drop("o_orderstatus"), counts["c_mktsegment"], "c_mktsegment")


@query(
    "semi_join_members",
    with_(POSITIVES)
    + "select o_orderkey, label from positives where label in "
    "(select label from positives group by label order by count(*) desc, label limit 5)",
)
def _(spark, d):
    pos = positives(spark, d)
    top = P.top_n(P.group_count(pos, ["label"]), "n", 5, "label")
    return J.semi_join_members(pos, top, "label")


@query(
    "align_runs",
    with_(RUNS)
    + "select b.class, round(b.score, 9) as baseline, round(f1.score, 9) as fe1, round(f2.score, 9) as fe2, "
    "round(f1.score - b.score, 9) as fe1_diff, round(f2.score - b.score, 9) as fe2_diff from runs b "
    "left join runs f1 on f1.class = b.class and f1.run = 'fe1' left join runs f2 on f2.class = b.class and f2.run = 'fe2' "
    "where b.run = 'baseline'",
)
def _(spark, d):
    wide = align_runs(runs(spark, d), RUN_NAMES)
    return wide.select("class", *[r(c, 9).alias(c) for c in wide.columns if c != "class"])
