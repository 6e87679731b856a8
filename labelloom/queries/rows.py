"""Row statistics, label targets and splits on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions.rowstats import STATS, keep_argmax, row_argmax, row_stat, row_stats
from labelloom.operators import splits as S
from labelloom.operators import targets as T
from labelloom.operators.ordering import row_batches
from labelloom.queries.columns import LABEL_SUMS
from labelloom.queries.frames import (
    CELLS,
    FEATURES,
    FOLDS,
    POSITIVES,
    VOCABULARY,
    features,
    keys,
    positives,
    r,
    table,
    vocabulary,
    with_,
)
from labelloom.queries.profiles import TOPK_SQL, TOTALS, top_classes
from labelloom.queries.registry import query

# SQL of each statistic over the list x
STAT_SQL = {
    "min": "list_min({x})",
    "max": "list_max({x})",
    "sum": "list_sum({x})",
    "mean": "list_avg({x})",
    "std": "sqrt(list_aggregate({x}, 'var_pop'))",
    "var": "list_aggregate({x}, 'var_pop')",
    "range": "list_max({x}) - list_min({x})",
    "p10": "list_aggregate({x}, 'quantile_cont', 0.1)",
    "p60": "list_aggregate({x}, 'quantile_cont', 0.6)",
    "p90": "list_aggregate({x}, 'quantile_cont', 0.9)",
    "p5": "list_aggregate({x}, 'quantile_cont', 0.05)",
    "p95": "list_aggregate({x}, 'quantile_cont', 0.95)",
    "p99": "list_aggregate({x}, 'quantile_cont', 0.99)",
}


# ---- one array per row
@query(
    "row_stats",
    with_(FEATURES)
    + "select vec_id, "
    + ", ".join(f"round({sql.format(x=g)}, 9) as {g}_{s}" for g in ("c", "g") for s, sql in STAT_SQL.items())
    + " from features",
)
def _(spark, d):
    out = row_stats(features(spark, d), ["c", "g"])
    names = [f"{g}_{s}" for g in ("c", "g") for s in STATS]
    return out.select("vec_id", *[r(n, 9).alias(n) for n in names])


def _single(stat: str) -> None:
    @query(
        f"row_{stat}",
        with_(FEATURES)
        + f"select vec_id, round({STAT_SQL[stat].format(x='c')}, 9) as c_{stat}, "
        + f"round({STAT_SQL[stat].format(x='g')}, 9) as g_{stat} from features",
    )
    def _(spark, d):
        return features(spark, d).select(
            "vec_id", *[r(row_stat(F.col(g), stat), 9).alias(f"{g}_{stat}") for g in ("c", "g")]
        )


for _stat in STATS:
    _single(_stat)


@query("row_label_sum", with_(POSITIVES, LABEL_SUMS) + "select o_orderkey, label_sum from label_sums")
def _(spark, d):
    return T.row_label_sum(keys(spark, d), positives(spark, d), "o_orderkey")


@query(
    "hidden_class",
    with_(POSITIVES) + "select o_orderkey from orders where o_orderkey not in (select o_orderkey from positives)",
)
def _(spark, d):
    return T.hidden_class(keys(spark, d), positives(spark, d), "o_orderkey")


@query(
    "hidden_class_skip_first",
    with_(POSITIVES)
    + "select o_orderkey from orders where o_orderkey not in "
    "(select o_orderkey from positives where label <> (select min(p_brand) from part))",
)
def _(spark, d):
    first = vocabulary(spark, d).orderBy("pos").first()["label"]
    return T.hidden_class(keys(spark, d), positives(spark, d), "o_orderkey", skip_label=first)


@query(
    "row_argmax",
    with_(FEATURES)
    + "select vec_id, 'c-' || (list_position(c, list_max(c)) - 1) as c_best, "
    "'g-' || (list_position(g, list_max(g)) - 1) as g_best from features",
)
def _(spark, d):
    return features(spark, d).select(
        "vec_id",
        row_argmax(F.col("c"), [f"c-{i}" for i in range(16)]).alias("c_best"),
        row_argmax(F.col("g"), [f"g-{i}" for i in range(48)]).alias("g_best"),
    )


@query(
    "keep_argmax",
    with_(FEATURES, CELLS)
    + "select vec_id, pos::int as pos, case when pos = list_position(c, list_max(c)) - 1 then v else 0 end as p "
    "from cells join features using (vec_id) where grp = 'c'",
)
def _(spark, d):
    kept = features(spark, d).select("vec_id", keep_argmax(F.col("c")).alias("p"))
    return kept.select("vec_id", F.posexplode("p").alias("pos", "p"))


# ---- one-vs-rest targets
@query(
    "ovr_targets",
    with_(POSITIVES, VOCABULARY, TOTALS, TOPK_SQL)
    + "select o.o_orderkey, t.label as class, case when t.label = 'hidden_class' then (h.o_orderkey is not null)::int "
    "else (p.label is not null)::int end as y from orders o cross join topk t "
    "left join positives p on p.o_orderkey = o.o_orderkey and p.label = t.label "
    "left join hidden h on h.o_orderkey = o.o_orderkey",
)
def _(spark, d):
    classes = [row["label"] for row in top_classes(spark, d).collect()]
    wide = T.ovr_targets(keys(spark, d), positives(spark, d), "o_orderkey", classes)
    return T.ovr_targets_long(wide, "o_orderkey", classes)


@query("empty_predictions", "select doc_id, 0.0::double as quality, 0.0::double as toxic from documents")
def _(spark, d):
    return T.empty_predictions(table(spark, d, "documents"), "doc_id", ["quality", "toxic"])


SIGNATURES = """counts as (select label, count(*) as n from positives group by label),
strata as (
  select o_orderkey, arg_min(label, (n, label)) as stratum, string_agg(label, ',' order by label) as signature
  from positives join counts using (label) group by o_orderkey),
label_folds as (
  select o_orderkey, cast((row_number() over (order by coalesce(stratum, ''), coalesce(signature, ''), o_orderkey) - 1) % 5
         as integer) as kfold from orders left join strata using (o_orderkey))"""


def label_folds(spark, d, seed=None):
    return S.multilabel_stratified_kfold(
        keys(spark, d), positives(spark, d), "o_orderkey", 5, seed
    )


@query(
    "class_balance",
    with_(POSITIVES, SIGNATURES)
    + "select v.label as class, kfold, cast(sum(case when p.label is null then 0 else 1 end) as bigint) as positives, "
    "count(*) as n from label_folds f cross join (select distinct label from positives) v "
    "left join positives p on p.o_orderkey = f.o_orderkey and p.label = v.label group by 1, 2",
)
def _(spark, d):
    classes = [row["label"] for row in vocabulary(spark, d).collect()]
    return T.class_balance(positives(spark, d), label_folds(spark, d), "o_orderkey", classes)


# ---- splits
@query(
    "train_valid_split",
    with_(FOLDS) + "select vec_id, case when kfold = 0 then 'valid' else 'train' end as part from folds",
)
def _(spark, d):
    folds = S.stratified_kfold(features(spark, d), "vec_id", "label")
    train, valid = S.train_valid_split(folds, 0)
    return (
        train.select("vec_id", F.lit("train").alias("part"))
        .unionByName(valid.select("vec_id", F.lit("valid").alias("part")))
    )


@query(
    "stratified_kfold",
    "select o_orderkey, o_orderpriority, cast((row_number() over (order by o_orderpriority, o_orderkey) - 1) % 5 as integer) "
    "as kfold from orders",
)
def _(spark, d):
    return S.stratified_kfold(table(spark, d, "orders"), "o_orderkey", "o_orderpriority")


@query(
    "multilabel_stratified_kfold",
    with_(POSITIVES, SIGNATURES) + "select o_orderkey, kfold from label_folds",
)
def _(spark, d):
    return label_folds(spark, d)


@query("multilabel_stratified_kfold_shuffled")
def _(spark, d):
    return label_folds(spark, d, seed=0)


@query(
    "holdout_split",
    "select o_orderkey, o_orderstatus, case when row_number() over (partition by o_orderstatus order by o_orderkey) "
    "<= 0.8::double * count(*) over (partition by o_orderstatus) then 'train' else 'valid' end as part from orders",
)
def _(spark, d):
    return S.holdout_split(table(spark, d, "orders"), "o_orderkey", "o_orderstatus", 0.8)


@query("bootstrap_sample")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return S.bootstrap_sample(rows, 1 / 3, 0)


@query(
    "row_batches",
    "select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 100 as batch from orders",
)
def _(spark, d):
    return row_batches(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 100)
