"""Encoders, scaling and principal components on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import encoders as E
from labelloom.operators import pca as K
from labelloom.operators.columns import bucket_tail, filter_eq
from labelloom.operators.reshape import melt_packed
from labelloom.operators.splits import stratified_kfold
from labelloom.plans.recipe import IntegerCode, Pca, Recipe, RowStats, Scale, column_count
from labelloom.queries.frames import (
    CELLS,
    FEATURES,
    FOLDS,
    SAMPLES,
    features,
    r,
    samples,
    table,
    with_,
)
from labelloom.queries.profiles import CATS
from labelloom.queries.registry import query
from labelloom.queries.rows import STAT_SQL

# fixed values: levels of the categoricals in the test tables, for the SQL column names
LEVELS = {
    "o_orderstatus": ["F", "O", "P"],
    "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "c_mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
}


@query(
    "one_hot",
    with_(SAMPLES)
    + "select o_orderkey, o_totalprice, c_acctbal, n_lines, qty, "
    + ", ".join(f"({c} = '{v}')::int as \"{c}_{v}\"" for c, vs in LEVELS.items() for v in vs)
    + " from samples",
)
def _(spark, d):
    rows = samples(spark, d)
    return E.one_hot(rows, E.category_levels(rows, CATS))


@query(
    "integer_encode",
    "select o_orderkey, o_orderpriority, dense_rank() over (order by o_orderpriority) - 1 as code from orders",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return E.integer_encode(rows, E.level_codes(rows, "o_orderpriority"), "o_orderpriority", "code")


def _scale_sql(sd: str) -> str:
    return with_(
        FEATURES,
        CELLS,
        f"fit as (select grp, pos, avg(v) as m, {sd}(v) as s from cells group by 1, 2)",
    ) + (
        "select vec_id, grp || '-' || pos as feature, round((v - m) / case when s = 0 then 1 else s end, 8) as value "
        "from cells join fit using (grp, pos)"
    )


def _scaled(spark, d, ddof):
    x = features(spark, d)
    for g in ("c", "g"):
        x = E.standard_scale(x, g, E.scale_fit(x, g), ddof)
    return melt_packed(x, ["vec_id"], ["c", "g"]).withColumn("value", r("value", 8))


@query("standard_scale", _scale_sql("stddev_pop"))
def _(spark, d):
    return _scaled(spark, d, 0)


@query("normalize_sample_sd", _scale_sql("stddev_samp"))
def _(spark, d):
    return _scaled(spark, d, 1)


def feature_folds(spark, d):
    x = features(spark, d)
    return x.join(stratified_kfold(x, "vec_id", "label").select("vec_id", "kfold"), "vec_id")


@query(
    "standard_scale_out_of_fold",
    with_(
        FEATURES,
        CELLS,
        FOLDS,
        "fit as (select f.kfold, grp, pos, avg(v) as m, stddev_pop(v) as s from "
        "(select distinct kfold from folds) f join (select * from cells join folds using (vec_id)) t on t.kfold <> f.kfold "
        "group by 1, 2, 3)",
    )
    + "select vec_id, kfold, grp || '-' || pos as feature, round((v - m) / s, 8) as value "
    "from cells join folds using (vec_id) join fit using (kfold, grp, pos)",
)
def _(spark, d):
    x = feature_folds(spark, d)
    for g in ("c", "g"):
        x = E.scale_out_of_fold(x, g)
    return melt_packed(x, ["vec_id", "kfold"], ["c", "g"]).withColumn("value", r("value", 8))


@query(
    "count_encode",
    with_(SAMPLES)
    + "select o_orderkey, "
    + ", ".join(f"(select count(*) from samples t where t.o_orderstatus = 'F' and t.{c} = s.{c})::double as {c}_counts" for c in CATS[1:])
    + " from samples s",
)
def _(spark, d):
    rows = samples(spark, d).select("o_orderkey", *CATS)
    train = filter_eq(rows, "o_orderstatus", "F")
    out = E.count_encode(rows, train, CATS[1:])
    return out.select("o_orderkey", *[F.col(f"{c}_counts").cast("double").alias(f"{c}_counts") for c in CATS[1:]])


@query(
    "count_encode_out_of_fold",
    with_(
        SAMPLES,
        "tagged as (select *, cast((row_number() over (order by o_orderstatus, o_orderkey) - 1) % 5 as integer) as kfold from samples)",
        *[
            f"{c}_n as (select f.kfold, {c}, count(*) as n from (select distinct kfold from tagged) f "
            f"join tagged t on t.kfold <> f.kfold group by 1, 2)"
            for c in CATS
        ],
    )
    + "select o_orderkey, t.kfold, "
    + ", ".join(f"{c}_n.n::double as {c}_counts" for c in CATS)
    + " from tagged t "
    + " ".join(f"left join {c}_n on {c}_n.kfold = t.kfold and {c}_n.{c} = t.{c}" for c in CATS),
)
def _(spark, d):
    rows = samples(spark, d).select("o_orderkey", *CATS)
    folds = stratified_kfold(rows, "o_orderkey", "o_orderstatus").select("o_orderkey", "kfold")
    out = E.count_encode_out_of_fold(rows.join(folds, "o_orderkey"), CATS)
    counts = [F.col(f"{c}_counts").cast("double").alias(f"{c}_counts") for c in CATS]
    return out.select("o_orderkey", "kfold", *counts)


# ---- principal components; the SQL squares the correlation matrix until one axis
# is left, takes it off and goes on with the next
AXES = ["one", "two", "three", "four", "five"]


def pca_sql(g: str, d: int, train: str, rows: str, axes: int = 2) -> str:
    """Tables {g}_z(vec_id, z) of scaled rows and, per axis, {g}_<axis>(v) and {g}_<axis>_value."""
    square = "[[list_dot_product(r, s) / sqrt(list_sum([list_dot_product(t, t) for t in a])) for s in a] for r in a]"
    pick = f"[a[i][i] for i in range(1, {d} + 1)]"

    def axis(name: str, source: str) -> str:
        return f"""{name}_pow as (
  select 0 as step, a from {source}
  union all select step + 1, {square} from {name}_pow where step < 40),
{name}_col as (
  select a[list_position({pick}, list_max({pick}))] as v from {name}_pow where step = 40),
{name}_unit as (select [x / sqrt(list_dot_product(v, v)) for x in v] as v from {name}_col),
{name} as (
  select case when list_max(v) >= -list_min(v) then v else [-x for x in v] end as v from {name}_unit),
{name}_value as (
  select list_dot_product([list_dot_product(r, v) for r in a], v) as value from {source}, {name}),
{name}_rest as (
  select [[a[i][j] - value * v[i] * v[j] for j in range(1, {d} + 1)] for i in range(1, {d} + 1)] as a
  from {source}, {name}, {name}_value)"""

    sources = [f"{g}_corr", *[f"{g}_{n}_rest" for n in AXES]]
    steps = ",\n".join(axis(f"{g}_{n}", src) for n, src in zip(AXES[:axes], sources))
    return f"""{g}_fit as (select pos, avg(v) as m, stddev_pop(v) as s from ({train}) group by 1),
{g}_train as (select vec_id, pos, (v - m) / s as z from ({train}) join {g}_fit using (pos)),
{g}_rows as (select vec_id, pos, (v - m) / s as z from ({rows}) join {g}_fit using (pos)),
{g}_z as (select vec_id, list(z order by pos) as z from {g}_rows group by 1),
{g}_pairs as (
  select a.pos as i, b.pos as j, sum(a.z * b.z) / (select count(distinct vec_id) from {g}_train) as s
  from {g}_train a join {g}_train b using (vec_id) group by 1, 2),
{g}_lines as (select i, list(s order by j) as line from {g}_pairs group by 1),
{g}_corr as (select list(line order by i) as a from {g}_lines),
{steps}"""


def pca_with(*groups: str, axes: int = 2) -> str:
    widths = {"c": 16, "g": 48}
    parts = []
    for g in groups:
        cells = f"select vec_id, pos, v from cells where grp = '{g}'"
        parts.append(pca_sql(g, widths[g], cells, cells, axes))
    return "with recursive " + ", ".join([FEATURES, CELLS, *parts]) + " "


def pca_folds_sql() -> str:
    parts, out = [], []
    for f in range(5):
        cells = "select vec_id, pos, v from cells join folds using (vec_id) where grp = 'c' and kfold"
        parts.append(pca_sql(f"c{f}", 16, f"{cells} <> {f}", f"{cells} = {f}"))
        out.append(
            f"select vec_id, {f} as kfold, round(list_dot_product(z, c{f}_one.v), 5) as c_pc1, "
            f"round(list_dot_product(z, c{f}_two.v), 5) as c_pc2 from c{f}_z, c{f}_one, c{f}_two"
        )
    return "with recursive " + ", ".join([FEATURES, CELLS, FOLDS, *parts]) + " union all ".join(out)


@query(
    "pca_features",
    pca_with("c", "g")
    + "select vec_id, "
    + ", ".join(
        f"round(list_dot_product({g}_z.z, {g}_{n}.v), 5) as {g}_pc{i}"
        for g in ("c", "g")
        for i, n in ((1, "one"), (2, "two"))
    )
    + " from c_z join g_z using (vec_id), c_one, c_two, g_one, g_two",
)
def _(spark, d):
    out = K.pca_features(features(spark, d), ["c", "g"])
    names = ["c_pc1", "c_pc2", "g_pc1", "g_pc2"]
    return out.select("vec_id", *[r(n, 5).alias(n) for n in names])


@query("pca_features_out_of_fold", pca_folds_sql())
def _(spark, d):
    x = feature_folds(spark, d)
    fits = K.fit_pca_folds(x, "c")
    parts = [
        K.pca_scores(x.filter(F.col("kfold") == f), "c", fit, "c_pc") for f, fit in sorted(fits.items())
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("vec_id", "kfold", r("c_pc1", 5).alias("c_pc1"), r("c_pc2", 5).alias("c_pc2"))


@query("pca_threshold")
def _(spark, d):
    x = features(spark, d)
    out = x.select("vec_id", "c", "g")
    for g in ("g", "c"):
        out = K.pca_scores(out, g, K.fit_pca(x, g, threshold=0.95, center=False, scaled=False), f"pc{g}_")
    return out.drop("c", "g")


@query(
    "pca_report",
    pca_with("c")
    + "select axis, round(value, 7) as eigenvalue, round(value / 16, 7) as share, 'c-' || (i - 1) as variable, "
    "round(v[i] * sqrt(value), 7) as coordinate, round(100 * v[i] * v[i], 6) as contribution from "
    "(select 1 as axis, v, value from c_one, c_one_value union all select 2, v, value from c_two, c_two_value), "
    "range(1, 17) t(i)",
)
def _(spark, d):
    x = features(spark, d)
    out = K.pca_report(x, "c", K.fit_pca(x, "c"))
    digits = {"eigenvalue": 7, "share": 7, "coordinate": 7, "contribution": 6}
    return out.withColumns({c: r(c, n) for c, n in digits.items()})


@query(
    "pca_top_contributions",
    pca_with("g")
    + "select variable, contribution from (select 'g-' || (i - 1) as variable, round(100 * v[i] * v[i], 6) as contribution "
    "from g_one, range(1, 49) t(i)) order by contribution desc, variable limit 15",
)
def _(spark, d):
    x = features(spark, d)
    report = K.pca_report(x, "g", K.fit_pca(x, "g"), axes=1)
    rows = report.select("variable", r("contribution", 6).alias("contribution"))
    return rows.orderBy(F.col("contribution").desc(), "variable").limit(15)


@query(
    "pca_variance",
    pca_with("g", axes=5)
    + " union all ".join(
        f"select {i + 1} as axis, round(value, 7) as eigenvalue, round(value / 48, 8) as share from g_{n}_value"
        for i, n in enumerate(AXES)
    ),
)
def _(spark, d):
    x = features(spark, d)
    shares = K.variance_shares(x, K.fit_pca(x, "g"), 5)
    return shares.select("axis", r("eigenvalue", 7).alias("eigenvalue"), r("share", 8).alias("share"))


@query(
    "pca_scores_by_group",
    pca_with("c")
    + "select case when label >= 3 then '3+' else label::varchar end as bucket, count(*) as n, "
    "round(avg(s1), 6) as c_pc1_mean, round(stddev_samp(s1), 6) as c_pc1_sd, round(avg(s2), 6) as c_pc2_mean, "
    "round(stddev_samp(s2), 6) as c_pc2_sd from (select vec_id, list_dot_product(z, c_one.v) as s1, "
    "list_dot_product(z, c_two.v) as s2 from c_z, c_one, c_two) join features using (vec_id) group by 1",
)
def _(spark, d):
    x = features(spark, d).withColumn("bucket", bucket_tail(F.col("label")))
    scores = K.pca_scores(x, "c", K.fit_pca(x, "c"), "c_pc")
    out = K.scores_by_group(scores, "bucket", ["c_pc1", "c_pc2"])
    return out.select("bucket", "n", *[r(c, 6).alias(c) for c in out.columns[2:]])


# ---- assembled matrices
@query(
    "assemble_vector",
    with_(FEATURES)
    + "select vec_id, 65 as width, label::double as first, g[48] as last, round(list_sum(c) + list_sum(g), 8) as total from features",
)
def _(spark, d):
    from pyspark.ml.functions import vector_to_array

    from labelloom.functions.arrays import total

    v = E.assemble_vector(features(spark, d), ["c", "g"], ["label"]).withColumn("v", vector_to_array("features"))
    return v.select(
        "vec_id",
        F.size("v").alias("width"),
        F.get("v", F.lit(0)).alias("first"),
        F.element_at("v", -1).alias("last"),
        r(total(F.slice("v", 2, 64)), 8).alias("total"),
    )


_STATS = [f"{sql.format(x=g)}" for g in ("c", "g") for sql in STAT_SQL.values()]


@query(
    "recipe",
    with_(
        FEATURES,
        CELLS,
        "stats as (select vec_id, [" + ", ".join(_STATS) + "] as s from features)",
        "matrix as (select vec_id, grp, pos, v from cells union all "
        "select vec_id, 's', generate_subscripts(s, 1) - 1, unnest(s) from stats)",
        "fit as (select grp, pos, avg(v) as m, stddev_pop(v) as sd from matrix group by 1, 2)",
    )
    + "select vec_id, count(*)::int as n_features, round(sum(abs((v - m) / sd)), 6) as total "
    "from matrix join fit using (grp, pos) group by vec_id",
)
def _(spark, d):
    x = features(spark, d)
    recipe = Recipe([RowStats(["c", "g"]), Scale(["c", "g", "stats"])], ["c", "g", "stats"])
    m = recipe.matrix(recipe.fit(x).transform(x), ["vec_id"])
    return m.select(
        "vec_id",
        F.size("x").alias("n_features"),
        r(F.aggregate("x", F.lit(0.0), lambda a, v: a + F.abs(v)), 6).alias("total"),
    )


@query("recipe_reduced")
def _(spark, d):
    """Integer codes, scaling and 95 % components; the column count before and after."""
    x = features(spark, d).withColumn("kind", F.col("label").cast("string"))
    recipe = Recipe(
        [
            IntegerCode(["kind"]),
            Scale(scalars=["label"], ddof=1),
            Pca(["g", "c"], threshold=0.95, center=False, scaled=False, replace=True),
        ],
        ["scalars", "pcg", "pcc"],
    )
    m = recipe.matrix(recipe.fit(x).transform(x), ["vec_id", "kind_code"])
    return m.select("vec_id", "kind_code", F.lit(column_count(x, ["c", "g"]) + 2).alias("columns_before"), (F.size("x") + 1).alias("columns_after"))
