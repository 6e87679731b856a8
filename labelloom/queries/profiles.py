"""Profiling, reshaping, ordering and set queries on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import ordering as O
from labelloom.operators import profile as P
from labelloom.operators import reshape as R
from labelloom.operators import targets as T
from labelloom.operators.density import density_grid
from labelloom.operators.pca import corr_matrix
from labelloom.operators.results import fold_mean
from labelloom.queries.columns import LABEL_SUMS, wide_features
from labelloom.queries.frames import (
    BRANDS,
    CELLS,
    FEATURES,
    FOLD_SCORES,
    POSITIVES,
    POSITIVES_FINE,
    RUNS,
    SAMPLES,
    VOCABULARY,
    features,
    fold_scores,
    keys,
    positives,
    positives_fine,
    r,
    runs,
    samples,
    table,
    vocabulary,
    with_,
)
from labelloom.queries.registry import query
from labelloom.roles import unpack

CATS = ["o_orderstatus", "o_orderpriority", "c_mktsegment"]
NUMS = ["o_totalprice", "c_acctbal", "n_lines", "qty"]


# ---- counts and shares
@query(
    "value_counts",
    with_(SAMPLES)
    + " union all ".join(f"select '{c}' as \"column\", {c} as level, count(*) as n from samples group by {c}" for c in CATS),
)
def _(spark, d):
    return P.value_counts(samples(spark, d), CATS)


@query(
    "count_share",
    "select o_orderstatus, count(*) as n, (select count(*) from orders) as total, "
    "round(count(*) / (select count(*) from orders), 9) as perc from orders group by 1",
)
def _(spark, d):
    return P.count_share(table(spark, d, "orders"), "o_orderstatus").withColumn("perc", r("perc", 9))


@query(
    "count_share_within",
    with_(SAMPLES, POSITIVES, LABEL_SUMS)
    + "select o_orderstatus, label_sum, n, cast(sum(n) over (partition by o_orderstatus) as bigint) as total, "
    "round(n / sum(n) over (partition by o_orderstatus), 9) as perc from "
    "(select o_orderstatus, label_sum, count(*) as n from samples join label_sums using (o_orderkey) group by 1, 2)",
)
def _(spark, d):
    sums = T.row_label_sum(keys(spark, d), positives(spark, d), "o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(sums, "o_orderkey")
    return P.count_share_within(rows, "o_orderstatus", "label_sum").withColumn("perc", r("perc", 9))


@query(
    "group_count_3",
    with_(SAMPLES)
    + "select o_orderstatus, o_orderpriority, c_mktsegment, count(*) as n from samples group by 1, 2, 3",
)
def _(spark, d):
    return P.group_count(samples(spark, d), CATS)


TOTALS = """totals as (
  select pos, label, coalesce(n, 0) as n from vocabulary
  left join (select label, count(*) as n from positives group by label) using (label))"""


@query("label_totals", with_(POSITIVES, VOCABULARY, TOTALS) + "select pos, label, n from totals")
def _(spark, d):
    return T.label_totals(positives(spark, d), vocabulary(spark, d))


# ---- column statistics
@query(
    "column_stats_long",
    with_(FEATURES, CELLS)
    + "select grp || '-' || pos as feature, stat, round(value, 9) as value from "
    "(select grp, pos, min(v) as min, max(v) as max, avg(v) as mean, stddev_samp(v) as sd from cells group by 1, 2) "
    "unpivot (value for stat in (min, max, mean, sd))",
)
def _(spark, d):
    x = features(spark, d)
    return P.column_stats(x, "c").unionByName(P.column_stats(x, "g")).withColumn("value", r("value", 9))


@query(
    "column_aggregates",
    with_(SAMPLES)
    + " union all ".join(
        f"select '{c}' as feature, '{stat}' as stat, round({sql}, 4) as value from samples"
        for c in NUMS
        for stat, sql in (("sum", f"cast(sum(cast({c} as decimal(18,2))) as double)"), ("max", f"max({c})::double"))
    ),
)
def _(spark, d):
    rows = samples(spark, d).select(*[F.col(c).cast("decimal(18,2)").alias(c) for c in NUMS])
    out = P.column_aggregates(rows, NUMS, {"sum": F.sum, "max": F.max})
    return out.withColumn("value", r("value", 4))


@query(
    "describe",
    with_(SAMPLES)
    + "select feature, count(value) as count, round(avg(value), 4) as mean, round(stddev_samp(value), 4) as std, "
    "min(value) as min, round(quantile_cont(value, 0.25), 4) as p25, round(quantile_cont(value, 0.5), 4) as p50, "
    "round(quantile_cont(value, 0.75), 4) as p75, max(value) as max from ("
    + " union all ".join(f"select '{c}' as feature, {c}::double as value from samples" for c in NUMS)
    + ") group by feature",
)
def _(spark, d):
    rows = samples(spark, d).withColumn("n_lines", F.col("n_lines").cast("double"))
    long = R.melt_features(rows.select(*NUMS), [], NUMS)
    out = P.describe(long, ["feature"], "value")
    return out.withColumns({c: r(c, 4) for c in ("mean", "std", "p25", "p50", "p75")})


@query(
    "min_std_check",
    with_(FEATURES, CELLS)
    + "select round(min(sd), 9) as min_sd, cast(sum(case when sd = 0 then 1 else 0 end) as bigint) as constant_columns "
    "from (select stddev_samp(v) as sd from cells group by grp, pos)",
)
def _(spark, d):
    both = features(spark, d).select(F.concat("c", "g").alias("x"))
    return P.constant_check(both, "x").withColumn("min_sd", r("min_sd", 9))


NULL_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]  # all of both tables


@query(
    "null_count",
    "select cast(sum("
    + " + ".join(f"case when {c} is null then 1 else 0 end" for c in NULL_COLS)
    + ") as bigint) as null_cells from documents left join labels using (doc_id)",
)
def _(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return P.null_count(docs.select(*NULL_COLS))


@query(
    "label_density",
    with_(POSITIVES_FINE)
    + "select count(*) as ones, round(count(*) / ((select count(*) from orders) * "
    "(select count(distinct p_brand || '_' || p_type) from part)) * 100, 9) as density_percent from positives_fine",
)
def _(spark, d):
    fine = F.concat_ws("_", "p_brand", "p_type").alias("label")
    vocab = table(spark, d, "part").select(fine).distinct()
    out = P.label_density(keys(spark, d), positives_fine(spark, d), vocab)
    return out.withColumn("density_percent", r("density_percent", 9))


@query(
    "duplicate_keys",
    "select count(*) - count(distinct l_orderkey) as duplicates from lineitem",
)
def _(spark, d):
    return P.duplicate_keys(table(spark, d, "lineitem"), "l_orderkey")


@query("distinct_labels", with_(POSITIVES_FINE) + "select count(distinct label) as n_labels from positives_fine")
def _(spark, d):
    return P.distinct_labels(positives_fine(spark, d), "label")


@query(
    "table_shape",
    "select 'train' as \"table\", count(*) as n_rows, 3 as n_columns, round(count(*) / (select count(*) from labels), 9) "
    "as ratio from labels union all select 'test', count(*), 5, round(count(*) / (select count(*) from labels), 9) "
    "from documents where doc_id not in (select doc_id from labels)",
)
def _(spark, d):
    labels, docs = table(spark, d, "labels"), table(spark, d, "documents")
    shapes = P.table_shape({"train": labels, "test": docs.join(labels, "doc_id", "left_anti")})
    train = labels.agg(F.count(F.lit(1))).scalar()
    return shapes.withColumn("ratio", r(F.col("n_rows") / train, 9))


@query(
    "labels_per_row_hist",
    with_(POSITIVES, LABEL_SUMS)
    + "select label_sum, count(*) as n, (select count(*) from label_sums) as total, "
    "round(count(*) / (select count(*) from label_sums), 9) as perc from label_sums group by label_sum",
)
def _(spark, d):
    sums = T.row_label_sum(keys(spark, d), positives(spark, d), "o_orderkey")
    return P.labels_per_row_hist(sums).withColumn("perc", r("perc", 9))


@query(
    "suffix_counts",
    "with names as (select distinct p_brand || '_' || p_type as label from part), "
    "counts as (select split_part(label, '_', -1) as suffix, count(*) as n from names group by 1) "
    "select suffix, n, cast((select sum(n) from counts) as bigint) as total, round(n / (select sum(n) from counts), 9) as perc "
    "from counts where n > 1",
)
def _(spark, d):
    names = table(spark, d, "part").select(F.concat_ws("_", "p_brand", "p_type").alias("label")).distinct()
    return P.suffix_counts(names).withColumn("perc", r("perc", 9))


TOPK_SQL = """hidden as (
  select o_orderkey from orders where o_orderkey not in (select o_orderkey from positives)),
topk as (
  select pos, label, n from (
    select pos, label, n from totals union all select 2147483647, 'hidden_class', count(*) from hidden)
  order by n desc, pos limit 13)"""


def top_classes(spark, d):
    return T.topk_classes(keys(spark, d), positives(spark, d), vocabulary(spark, d), "o_orderkey", 12)


@query("topk_classes", with_(POSITIVES, VOCABULARY, TOTALS, TOPK_SQL) + "select pos, label, n from topk")
def _(spark, d):
    return top_classes(spark, d)


@query(
    "topn",
    with_(POSITIVES_FINE)
    + "select label, count(*) as n from positives_fine group by label order by n desc, label limit 5",
)
def _(spark, d):
    return P.top_n(P.group_count(positives_fine(spark, d), ["label"]), "n", 5, "label")


@query(
    "bottomn",
    with_(POSITIVES_FINE)
    + "select label, count(*) as n from positives_fine group by label order by n, label limit 5",
)
def _(spark, d):
    return P.bottom_n(P.group_count(positives_fine(spark, d), ["label"]), "n", 5, "label")


@query(
    "corr_matrix",
    with_(FEATURES, CELLS)
    + "select a.grp, a.pos::int as i, b.pos::int as j, round(corr(a.v, b.v), 9) as r from cells a "
    "join cells b on a.vec_id = b.vec_id and a.grp = b.grp and a.pos > b.pos group by 1, 2, 3",
)
def _(spark, d):
    x = features(spark, d)
    c = corr_matrix(x, "c").withColumn("grp", F.lit("c"))
    return c.unionByName(corr_matrix(x, "g").withColumn("grp", F.lit("g"))).withColumn("r", r("r", 9))


# fixed values: the pairs of gene and cell columns the exploration looks at
PAIRS = [("g", 0, 8), ("g", 10, 17), ("g", 0, 3), ("g", 10, 19), ("c", 1, 2), ("c", 3, 4), ("c", 5, 9), ("c", 0, 6)]


@query(
    "pair_fit",
    with_(FEATURES)
    + " union all ".join(
        f"select '{g}-{a}' as x, '{g}-{b}' as y, round(corr({g}[{b + 1}], {g}[{a + 1}]), 9) as corr, "
        f"round(regr_slope({g}[{b + 1}], {g}[{a + 1}]), 9) as slope, "
        f"round(regr_intercept({g}[{b + 1}], {g}[{a + 1}]), 9) as intercept, "
        f"round(regr_r2({g}[{b + 1}], {g}[{a + 1}]), 9) as r2 from features"
        for g, a, b in PAIRS
    ),
)
def _(spark, d):
    wide = unpack(features(spark, d), {"c": 16, "g": 48})
    out = P.pair_fit(wide, [(f"{g}-{a}", f"{g}-{b}") for g, a, b in PAIRS])
    return out.withColumns({c: r(c, 9) for c in ("corr", "slope", "intercept", "r2")})


DENSITY_POINTS = 128


@query(
    "density_grid",
    f"""with stats as (
  select event_type, count(value) as n, min(value) as lo, max(value) as hi, stddev_samp(value) as sd,
         quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events group by 1),
shape as (
  select event_type, n, 0.9 * least(sd, (q3 - q1) / 1.34) * pow(n, -0.2) as bw, lo, hi from stats),
bounds as (select event_type, n, bw, lo - 3 * bw as start, (hi - lo + 6 * bw) / {DENSITY_POINTS - 1} as step from shape),
bins as (
  select event_type, floor((value - start) / step + 0.5) as bin, count(*) as c
  from events join bounds using (event_type) group by 1, 2),
grid as (select event_type, n, bw, start, step, unnest(range({DENSITY_POINTS})) as grid_id from bounds)
select event_type, grid_id::int as grid_id, round(any_value(start + grid_id * step), 6) as x,
       round(sum(c * exp(-0.5 * pow((grid_id - bin) * step / bw, 2))) / any_value(n * bw * 2.5066282746310002::double), 9) as density
from grid join bins using (event_type) group by event_type, grid_id""",
)
def _(spark, d):
    out = density_grid(table(spark, d, "events"), ["event_type"], "value", DENSITY_POINTS)
    return out.withColumns({"x": r("x", 6), "density": r("density", 9)})


@query(
    "fold_mean",
    with_(FOLD_SCORES)
    + "select class, clf, params, round(avg(score), 9) as mean_score from fold_scores group by 1, 2, 3",
)
def _(spark, d):
    means = fold_mean(fold_scores(spark, d), ["class", "clf", "params"])
    return means.withColumn("mean_score", r("mean_score", 9))


TAIL = (
    "list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})) "
    "for i in range({start}, n + 1)])"
)


# the SQL bisects on the binomial tail sum
@query(
    "proportion_ci",
    f"""with recursive counts as (
  select lang, cast(sum(toxic) as bigint) as x, count(*) as n from documents join labels using (doc_id) group by 1),
halves as (
  select lang, x, n, 0 as step, 0.0::double as a, 1.0::double as b, 0.0::double as c, 1.0::double as d from counts
  union all
  select lang, x, n, step + 1,
         case when t1 < 0.025 then (a + b) / 2 else a end, case when t1 < 0.025 then b else (a + b) / 2 end,
         case when t2 < 0.975 then (c + d) / 2 else c end, case when t2 < 0.975 then d else (c + d) / 2 end
  from (select *, {TAIL.format(p='((a + b) / 2)', start='x')} as t1, {TAIL.format(p='((c + d) / 2)', start='x + 1')} as t2
        from halves where step < 60))
select lang, x, n, round(case when x = 0 then 0 else a end, 8) as lwr, round(case when x = n then 1 else c end, 8) as upr
from halves where step = 60""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    rows = docs.join(table(spark, d, "labels"), "doc_id")
    out = P.proportion_ci(rows, ["lang"], "toxic")
    return out.withColumns({"lwr": r("lwr", 8), "upr": r("upr", 8)})


# ---- reshape
@query(
    "melt_features",
    with_(FEATURES, CELLS)
    + "select vec_id, grp || '-' || pos as feature, v as value from cells",
)
def _(spark, d):
    return R.melt_packed(features(spark, d), ["vec_id"], ["c", "g"])


@query(
    "melt_wide",
    with_(FEATURES, CELLS)
    + "select vec_id, label, 'c-' || pos as feature, v as value from cells join features using (vec_id) where grp = 'c'",
)
def _(spark, d):
    return R.melt_features(wide_features(spark, d), ["vec_id", "label"], [f"c-{i}" for i in range(16)])


@query(
    "melt_twice",
    "with f as (select doc_id, n_chars as value, 'n_chars' as feature from documents union all "
    "select doc_id, len(string_split(text, ' ')), 'n_words' from documents), "
    "c as (select doc_id, 'quality' as class_name, quality as class_value from labels union all "
    "select doc_id, 'toxic', toxic from labels) "
    "select doc_id, feature, value::bigint as value, class_name, class_value from f join c using (doc_id)",
)
def _(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", "n_chars", F.size(F.split("text", " ")).cast("bigint").alias("n_words")
    )
    rows = docs.join(table(spark, d, "labels"), "doc_id")
    return R.melt_twice(rows, ["doc_id"], ["n_chars", "n_words"], ["quality", "toxic"])


@query(
    "split_name",
    "select distinct p_brand || '_' || p_type as name, p_brand as feature, p_type as stat from part",
)
def _(spark, d):
    name = table(spark, d, "part").select(F.concat_ws("_", "p_brand", "p_type").alias("name")).distinct()
    return name.select(
        "name",
        R.split_name(F.col("name"), "_", 1).alias("feature"),
        R.split_name(F.col("name"), "_", 2).alias("stat"),
    )


@query(
    "split_fill_left",
    "select p_partkey, t[-3] as a, t[-2] as b, t[-1] as type from "
    "(select p_partkey, (string_split(p_name, ' '))[1:3] as t from part)",
)
def _(spark, d):
    parts = R.split_fill_left(F.col("p_name"), " ", ["a", "b", "type"])
    return table(spark, d, "part").select("p_partkey", *parts)


@query(
    "transpose_results",
    with_(RUNS)
    + "select run, "
    + ", ".join(f"round(max(case when class = '{b}' then score end), 9) as \"{b}\"" for b in BRANDS)
    + " from runs group by run",
)
def _(spark, d):
    wide = R.transpose_results(runs(spark, d), "run", "class", "score", BRANDS)
    return wide.select("run", *[r(F.col(f"`{b}`"), 9).alias(b) for b in BRANDS])


@query(
    "label_from_onehot",
    with_(POSITIVES)
    + "select o_orderkey, coalesce(min(label), 'hidden_class') as label from orders left join positives using (o_orderkey) group by 1",
)
def _(spark, d):
    return T.label_from_onehot(keys(spark, d), positives(spark, d), vocabulary(spark, d), "o_orderkey")


@query(
    "label_from_dense",
    "select doc_id, case when quality >= toxic then 'quality' else 'toxic' end as label from labels",
)
def _(spark, d):
    onehot = F.array(F.col("quality").cast("double"), F.col("toxic").cast("double"))
    rows = table(spark, d, "labels")
    return rows.select("doc_id", T.dense_argmax(onehot, ["quality", "toxic"]).alias("label"))


@query(
    "onehot_from_label",
    "select vec_id, " + ", ".join(f"(label = {i})::int as \"{i}\"" for i in range(10)) + " from embeddings",
)
def _(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"))
    return T.onehot_from_label(rows, "label", [str(i) for i in range(10)])


# ---- order and limits
@query(
    "sort_desc",
    with_(POSITIVES_FINE)
    + "select label, n, cast(row_number() over (order by n desc, label) - 1 as bigint) as position from "
    "(select label, count(*) as n from positives_fine group by label)",
)
def _(spark, d):
    counts = P.group_count(positives_fine(spark, d), ["label"]).withColumn("__d", -F.col("n"))
    return O.with_position(counts, ["__d", "label"]).drop("__d").orderBy(F.col("n").desc(), "label")


@query(
    "reorder_levels",
    "select p_type, min(p_retailprice) as order_value from part group by p_type",
)
def _(spark, d):
    return P.reorder_levels(table(spark, d, "part"), "p_type", "p_retailprice")


# the SQL names the rows only: a permutation holds each of them once
@query("shuffle", "select o_orderkey, o_orderstatus from orders")
def _(spark, d):
    return O.shuffle_rows(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 7)


@query(
    "limit",
    "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rows.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)


# ---- sets
@query(
    "append_rows",
    "select 'customer' as kind, c_custkey as id, c_nationkey as nation, c_acctbal as balance from customer union all "
    "select 'supplier', s_suppkey, s_nationkey, s_acctbal from supplier",
)
def _(spark, d):
    def side(name, p, key):
        return table(spark, d, name).select(
            F.lit(name).alias("kind"),
            F.col(key).alias("id"),
            F.col(f"{p}_nationkey").alias("nation"),
            F.col(f"{p}_acctbal").alias("balance"),
        )

    return side("customer", "c", "c_custkey").unionByName(side("supplier", "s", "s_suppkey"))


@query(
    "label_gap",
    "with a as (select distinct o_custkey as label from orders where o_orderstatus = 'F'), "
    "b as (select distinct o_custkey as label from orders where o_orderstatus = 'O') "
    "select label, 'valid' as missing_in from a where label not in (select label from b) union all "
    "select label, 'train' from b where label not in (select label from a)",
)
def _(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("label"), "o_orderstatus")
    f, o = (rows.filter(F.col("o_orderstatus") == s) for s in ("F", "O"))
    return P.label_gap(f, o, "label")


@query("distinct_values", "select distinct p_type from part")
def _(spark, d):
    return table(spark, d, "part").select("p_type").distinct()


@query(
    "conformance_check",
    "select 'complete' as output, true as same_shape, true as same_keys, true as same_columns union all "
    "select 'labelled only', (select count(*) from documents) = (select count(*) from labels), "
    "(select count(*) from documents where doc_id not in (select doc_id from labels)) = 0, false",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit(0.0).alias("quality"), F.lit(0.0).alias("toxic"))
    same = P.conformance_check(docs, docs.select("doc_id", "quality", "toxic"), "doc_id")
    part = P.conformance_check(table(spark, d, "labels").select("doc_id", "quality"), docs, "doc_id")
    # a missing column alone makes the shape differ
    return same.withColumn("output", F.lit("complete")).unionByName(
        part.withColumn("output", F.lit("labelled only"))
    )
