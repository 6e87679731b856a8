"""Models, metrics, search and scored output on the given tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from labelloom.functions.arrays import total
from labelloom.models.bayes import fit_bayes
from labelloom.models.linear import fit_margin, logistic, multinomial
from labelloom.models.lsh import knn_lsh
from labelloom.models.neighbours import knn_proba, neighbours
from labelloom.models.ovr import fit_ovr, predictions_long, score_ovr
from labelloom.models.trees import boosted, forest, single_tree
from labelloom.operators import metrics as M
from labelloom.operators import results as R
from labelloom.operators import targets as T
from labelloom.operators.encoders import assemble_vector
from labelloom.operators.splits import multilabel_stratified_kfold, train_valid_split
from labelloom.plans import scoring as P
from labelloom.plans.project import feature_recipes
from labelloom.plans.recipe import OneHot, Recipe, Scale
from labelloom.plans.search import METRICS, evaluated, greedy_feature_sets, grid_search, multilabel_cv, out_of_fold
from labelloom.queries.features import LEVELS, feature_folds
from labelloom.queries.frames import (
    CELLS,
    FEATURES,
    FOLD_SCORES,
    FOLDS,
    MEANS,
    POSITIVES,
    PREDICTIONS,
    RUN_NAMES,
    RUNS,
    SAMPLES,
    VOCABULARY,
    features,
    fold_scores,
    keys,
    positives,
    predictions,
    r,
    runs,
    samples,
    table,
    text_features,
    vocabulary,
    with_,
)
from labelloom.queries.logistic import logistic_many_sql, logistic_sql, proba, softmax_sql
from labelloom.queries.profiles import CATS, NUMS, TOPK_SQL, TOTALS, top_classes
from labelloom.queries.registry import query
from labelloom.queries.rows import SIGNATURES
from labelloom.roles import HIDDEN, Roles
from labelloom.session import settle

# ---- models: embedding label 0 against the rest, fitted outside fold 0, applied to fold 0


def _binary(spark, d):
    rows = assemble_vector(feature_folds(spark, d), ["c", "g"])
    rows = rows.withColumn("y", (F.col("label") == 0).cast("double"))
    return train_valid_split(rows.select("vec_id", "kfold", "label", "y", "features"), 0)


def _scored(model, valid):
    p = vector_to_array("probability")[1]
    return model.transform(valid).select("vec_id", F.col("y").cast("int").alias("y"), p.alias("p"))


EMBEDDED = """embedded as materialized (
  select vec_id, kfold, label, list_concat(c, g, [1.0::double]) as x from features join folds using (vec_id))"""


def _rounded(df, digits=4):
    return df.withColumn("p", r("p", digits))


@query(
    "logreg_ovr",
    "with recursive "
    + ", ".join(
        [
            FEATURES,
            FOLDS,
            EMBEDDED,
            "strength as (select 'zero' as model, 1.0::double as c)",
            "train as materialized (select 'zero' as model, x, (label = 0)::int as y from embedded where kfold <> 0)",
            logistic_sql(64, 80),
        ]
    )
    + f"select vec_id, (label = 0)::int as y, round({proba('w', 'x')}, 4) as p from embedded, weights where kfold = 0",
)
def _(spark, d):
    train, valid = _binary(spark, d)
    model = logistic(1.0, train.count(), tol=1e-9).fit(train)
    return _rounded(_scored(model, valid))


@query(
    "logreg_multinomial",
    "with recursive "
    + ", ".join(
        [
            FEATURES,
            FOLDS,
            EMBEDDED,
            "penalty as (select 1.0::double as c)",
            "train as materialized (select vec_id as id, label, x from embedded where kfold <> 0)",
            softmax_sql(64, 10, 160),
        ]
    )
    + "select vec_id, e.label, w.label::int as class, round(exp(list_dot_product(w, x)) / "
    "sum(exp(list_dot_product(w, x))) over (partition by vec_id), 4) as p from embedded e, weights w where kfold = 0",
)
def _(spark, d):
    train, valid = _binary(spark, d)
    model = multinomial(1.0, train.count(), "label", tol=1e-9).fit(train)
    return _rounded(
        model.transform(valid).select(
            "vec_id", "label", F.posexplode(vector_to_array("probability")).alias("class", "p")
        )
    )


@query("random_forest")
def _(spark, d):
    train, valid = _binary(spark, d)
    return _scored(forest(120, 8, 10, 10, "log2").fit(train), valid)


@query("decision_tree")
def _(spark, d):
    train, valid = _binary(spark, d)
    return _scored(single_tree(8, 10, 10, "log2").fit(train), valid)


@query("boosted_trees")
def _(spark, d):
    train, valid = _binary(spark, d)
    model = boosted(0.1, 0.05, 3, 1, 0.6, 0.6, n_estimators=10).fit(train)
    return _scored(model, valid)


@query("margin_classifier")
def _(spark, d):
    train, valid = _binary(spark, d)
    return _scored(fit_margin(train, 1.0, train.count(), 64, balanced=True), valid)


KNN_SQL = """near as (
  select q.vec_id, t.vec_id as neighbour, t.label, row_number() over (partition by q.vec_id order by
         {distance}, t.vec_id) as rank
  from (select * from features join folds using (vec_id) where kfold = 0) q
  join (select * from features join folds using (vec_id) where kfold <> 0) t on true)"""


def _near(spark, d, k, p):
    train, valid = train_valid_split(feature_folds(spark, d), 0)
    x = F.concat("c", "g").alias("x")
    return neighbours(
        train.select("vec_id", x), valid.select("vec_id", x), "vec_id", "x", k, p
    ), train


@query(
    "knn_proba",
    with_(FEATURES, FOLDS, KNN_SQL.format(distance="list_distance(q.c || q.g, t.c || t.g)"))
    + "select vec_id, label::varchar as class, count(*) / 4 as p from near where rank <= 4 group by 1, 2",
)
def _(spark, d):
    near, train = _near(spark, d, 4, 2)
    labels = train.select("vec_id", F.col("label").cast("string").alias("label"))
    return knn_proba(near, labels, "vec_id", 4)


@query("knn_lsh")
def _(spark, d):
    train, valid = train_valid_split(feature_folds(spark, d), 0)
    x = F.concat("c", "g").alias("x")
    near = knn_lsh(train.select("vec_id", x), valid.select("vec_id", x), "vec_id", "x", 4)
    labels = train.select("vec_id", F.col("label").cast("string").alias("label"))
    return knn_proba(near, labels, "vec_id", 4)


@query(
    "knn_neighbours_p3",
    with_(
        FEATURES,
        FOLDS,
        KNN_SQL.format(
            distance="list_sum([pow(abs(u), 3) for u in [(q.c || q.g)[i] - (t.c || t.g)[i] for i in range(1, 65)]])"
        ),
    )
    + "select vec_id, neighbour, rank::int as rank from near where rank <= 4",
)
def _(spark, d):
    near, _ = _near(spark, d, 4, 3)
    return near.select("vec_id", "neighbour", "rank")


@query(
    "gaussian_nb",
    with_(
        FEATURES,
        FOLDS,
        "train as materialized (select label, generate_subscripts(c, 1) as pos, unnest(c) as v from features join folds using (vec_id) "
        "where kfold <> 0)",
        "extra as (select 1e-9::double * max(s) as e from (select var_pop(v) as s from train group by pos))",
        "fit as (select label, list(m order by pos) as m, list(s + e order by pos) as s, any_value(n) as n from "
        "(select label, pos, avg(v) as m, var_pop(v) as s, count(*) as n from train group by 1, 2), extra group by label)",
        "joint as (select vec_id, fit.label, ln(n / (select sum(n) from fit)) - 0.5 * list_sum([ln(2 * pi() * x) for x in s]) "
        "- 0.5 * list_sum([(f.c[i] - m[i]) * (f.c[i] - m[i]) / s[i] for i in range(1, 17)]) as j "
        "from features f join folds using (vec_id), fit where kfold = 0)",
        "top as (select *, exp(j - max(j) over (partition by vec_id)) as e from joint)",
    )
    + "select vec_id, label as class, round(e / sum(e) over (partition by vec_id), 8) as p from top",
)
def _(spark, d):
    train, valid = train_valid_split(feature_folds(spark, d), 0)
    model = fit_bayes(train, "c", "label")
    cells = F.posexplode("probs").alias("pos", "p")
    names = F.array(*[F.lit(c) for c in model.classes])
    long = model.transform(valid).select("vec_id", cells)
    return long.select("vec_id", F.get(names, F.col("pos")).alias("class"), r("p", 8).alias("p"))


@query(
    "ovr_fit_predict",
    "with recursive "
    + ", ".join(
        [
            FEATURES,
            FOLDS,
            EMBEDDED,
            "models as materialized (select i::varchar as model, 0 as part, i + 1 as k, 1.0::double as c from range(10) t(i))",
            "train as materialized (select 0 as part, x, [(label = i)::int for i in range(10)] as ys from embedded where kfold <> 0)",
            logistic_many_sql(64, 120),
        ]
    )
    + f"select vec_id, model as label, round({proba('w', 'x')}, 4) as p from embedded, weights where kfold = 0",
)
def _(spark, d):
    classes = [str(i) for i in range(10)]
    rows = assemble_vector(feature_folds(spark, d), ["c", "g"])
    rows = rows.withColumns({c: (F.col("label") == int(c)).cast("int") for c in classes})
    train, valid = train_valid_split(rows, 0)
    model = fit_ovr(train.select("features", *classes), classes, [1.0] * len(classes))
    scored = score_ovr(valid.select("vec_id", "features"), model)
    return _rounded(predictions_long(scored, "vec_id", classes))


@query(
    "class_weights",
    "select toxic as y, count(*) as n_class, round((select count(*) from labels) / "
    "((select count(distinct toxic) from labels) * count(*)), 9) as weight from labels group by toxic",
)
def _(spark, d):
    rows = table(spark, d, "labels").select(F.col("toxic").alias("y"))
    return T.class_weights(rows, "y").withColumn("weight", r("weight", 9))


# ---- metrics
LONG_SQL = """long as (
  select doc_id, 'toxic' as class, toxic as y, p_toxic as p from predictions union all
  select doc_id, 'quality', quality, p_quality from predictions)"""
SAFE = "case when p = 0 then 1e-15::double when p = 1 then 1 - 1e-15::double else p end"
LOSS = f"-(y * ln({SAFE}) + (1 - y) * ln(1 - {SAFE}))"


def _long(spark, d):
    rows = predictions(spark, d)
    return rows.select(
        "doc_id",
        F.inline(
            F.array(
                F.struct(F.lit("toxic").alias("class"), F.col("toxic").alias("y"), F.col("p_toxic").alias("p")),
                F.struct(
                    F.lit("quality").alias("class"), F.col("quality").alias("y"), F.col("p_quality").alias("p")
                ),
            )
        ),
    )


@query(
    "multilabel_log_loss",
    with_(PREDICTIONS, LONG_SQL)
    + f"select round(avg(loss), 8) as log_loss from (select class, avg({LOSS}) as loss from long group by class)",
)
def _(spark, d):
    long = _long(spark, d).select("doc_id", F.col("class").alias("label"), "y", "p")
    sparse = long.filter(F.col("p") > 0).select("doc_id", "label", "p")
    truth = T.positives_from_wide(table(spark, d, "labels"), "doc_id", ["quality", "toxic"])
    n = table(spark, d, "labels").agg(F.count(F.lit(1))).scalar()
    out = M.multilabel_log_loss(sparse, truth, "doc_id", n, F.lit(2))
    return out.withColumn("log_loss", r("log_loss", 8))


@query(
    "class_log_loss",
    with_(PREDICTIONS, LONG_SQL) + f"select class, round(avg({LOSS}), 8) as log_loss from long group by class",
)
def _(spark, d):
    return M.class_log_loss(_long(spark, d), ["class"]).withColumn("log_loss", r("log_loss", 8))


@query(
    "class_log_loss_raw",
    with_(PREDICTIONS, LONG_SQL)
    + "select class, case when isinf(avg(loss)) then null else round(avg(loss), 8) end as log_loss, "
    "isinf(avg(loss)) as infinite from (select class, "
    "case when y = 1 and p = 0 or y = 0 and p = 1 then 'inf'::double when p = 0 or p = 1 then null "
    "else -(y * ln(p) + (1 - y) * ln(1 - p)) end as loss from long) group by class",
)
def _(spark, d):
    raw = M.class_log_loss(_long(spark, d), ["class"], eps=None)
    infinite = F.col("log_loss") == F.lit(float("inf"))
    return raw.select(
        "class", F.when(~infinite, r("log_loss", 8)).alias("log_loss"), infinite.alias("infinite")
    )


# class probabilities of label 0..8 from the first dimensions; label 9 is unknown to the "model"
@query(
    "log_loss_with_labels",
    with_(
        FEATURES,
        "scores as (select label, [abs(c[i]) for i in range(1, 10)] as s from features)",
        "probs as (select label, [x / list_sum(s) for x in s] as p from scores)",
        "safe as (select label, [greatest(least(x, 1 - 1e-15::double), 1e-15::double) for x in p] as p from probs)",
    )
    + "select round(avg(-ln(case when label > 8 then 1e-15::double else p[label + 1] / list_sum(p) end)), 8) as log_loss from safe",
)
def _(spark, d):
    x = features(spark, d).select("label", F.transform(F.slice("c", 1, 9), F.abs).alias("s"))
    x = x.withColumn("t", total(F.col("s"))).withColumn("probs", F.transform("s", lambda v: v / F.col("t")))
    x = x.withColumn("name", F.col("label").cast("string"))
    out = M.log_loss_with_labels(x, "probs", "name", [str(i) for i in range(9)])
    return out.withColumn("log_loss", r("log_loss", 8))


@query(
    "auc",
    with_(PREDICTIONS, LONG_SQL)
    + """, ranked as (
  select class, y, rank() over (partition by class order by p) + (count(*) over (partition by class, p) - 1) / 2.0 as rk
  from long)
select class, round((sum(case when y = 1 then rk else 0 end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 9)::double
  as auc from ranked group by class""",
)
def _(spark, d):
    return M.auc(_long(spark, d), ["class"], "p", "y").withColumn("auc", r("auc", 9))


@query(
    "auc_hard_labels",
    with_(PREDICTIONS, LONG_SQL)
    + """, hard as (select class, y, (p > 0.5)::int as p from long), ranked as (
  select class, y, rank() over (partition by class order by p) + (count(*) over (partition by class, p) - 1) / 2.0 as rk
  from hard)
select class, round((sum(case when y = 1 then rk else 0 end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 9)::double
  as auc from ranked group by class""",
)
def _(spark, d):
    hard = _long(spark, d).withColumn("p", (F.col("p") > 0.5).cast("int"))
    return M.auc(hard, ["class"], "p", "y").withColumn("auc", r("auc", 9))


@query(
    "accuracy",
    with_(PREDICTIONS, LONG_SQL)
    + "select class, round(avg((y = (p > 0.5)::int)::int), 9) as accuracy from long group by class",
)
def _(spark, d):
    rows = _long(spark, d).withColumn("predicted", (F.col("p") > 0.5).cast("int"))
    return M.accuracy(rows, ["class"], "y", "predicted").withColumn("accuracy", r("accuracy", 9))


# ---- search
# fixed values: the grid of the final search, in its order; the split and leaf
# sizes are the ones the forest and tree share
SEARCH_GRID = {
    "log_reg": {"penalty": ["l2"], "C": [0.001, 0.01, 0.1, 1, 10, 100]},
    "rf": {
        "n_estimators": [120],
        "max_depth": [8],
        "min_samples_split": [10],
        "min_samples_leaf": [10],
        "max_features": ["log2"],
    },
    "dt": {"max_depth": [8], "min_samples_split": [10], "min_samples_leaf": [10], "max_features": ["log2"]},
    "knn": {"n_neighbors": [2, 4], "p": [2]},
    "nb": {"dummy_param": [None]},
    "xgb": {
        "eta": [0.01],
        "gamma": [0.05],
        "max_depth": [8],
        "min_child_weight": [1],
        "subsample": [0.6],
        "colsample_bytree": [0.6],
        "lambda": [0.01],
        "alpha": [0.1],
    },
}
GRID_VALUES = ", ".join(
    f"('{clf}', {i}, '{R.params_text(p)}')" for clf, i, p in R.combinations(SEARCH_GRID)
)


@query(
    "param_grid",
    with_(POSITIVES, VOCABULARY, TOTALS, TOPK_SQL)
    + f"select label as class, clf, ordinal, params from topk, (values {GRID_VALUES}) t(clf, ordinal, params)",
)
def _(spark, d):
    return R.param_grid(top_classes(spark, d).select(F.col("label").alias("class")), SEARCH_GRID)


def order_cv(spark, d, classes, pos):
    """Samples with balanced folds and one 0/1 column per class."""
    folds = multilabel_stratified_kfold(keys(spark, d), pos, "o_orderkey")
    y = T.ovr_targets(keys(spark, d), pos, "o_orderkey", classes)
    return samples(spark, d).join(folds, "o_orderkey").join(y, "o_orderkey")


BASE = Recipe([OneHot(CATS), Scale(scalars=NUMS)], ["onehot", "scalars"])


CV_SQL = [
    SAMPLES,
    POSITIVES,
    VOCABULARY,
    TOTALS,
    TOPK_SQL,
    SIGNATURES,
    "top as (select label as class, row_number() over (order by n desc, pos) as k from topk)",
    "held as (select o_orderkey, list(label) as labels from positives group by 1)",
    "targets as (select o_orderkey, list(case when class = 'hidden_class' then (labels is null)::int else "
    "coalesce(list_contains(labels, class), false)::int end order by k) as ys "
    "from samples left join held using (o_orderkey), top group by 1)",
    "truth as (select s.*, kfold, ys from samples s join label_folds using (o_orderkey) join targets using (o_orderkey))",
    "fold as (select distinct kfold as f from label_folds)",
    "fit as (select f, "
    + ", ".join(f"avg({c}) as {c}_m, stddev_pop({c}) as {c}_s" for c in NUMS)
    + " from fold join truth on kfold <> f group by f)",
    "matrix as materialized (select f, o_orderkey, kfold, ys, ["
    + ", ".join(f"({c} = '{v}')::int::double" for c, vs in LEVELS.items() for v in vs)
    + ", "
    + ", ".join(f"({c} - {c}_m) / {c}_s" for c in NUMS)
    + ", 1.0::double] as x from truth, fit)",
    "train as materialized (select f as part, x, ys from matrix where kfold <> f)",
    "models as materialized (select f || '/' || class as model, f as part, k, 1.0::double as c from fold, top)",
]
AUC_SQL = """(sum(case when y = 1 then rank_mid end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))"""


@query(
    "cv_run",
    "with recursive "
    + ", ".join([*CV_SQL, logistic_many_sql(17, 60)])
    + f", scored as (select class, f as fold, ys[k] as y, {proba('w', 'x')} as p from matrix join weights on part = f "
    "join top using (k) where kfold = f), ranked as (select *, rank() over (partition by class, fold order by p) + "
    "(count(*) over (partition by class, fold, p) - 1) / 2.0 as rank_mid from scored) "
    + f"select class, fold, round(avg({LOSS}), 6) as log_loss, round({AUC_SQL}, 5) as auc, "
    "round(avg(((p > 0.5)::int = y)::int), 5) as accuracy from ranked group by 1, 2",
)
def _(spark, d):
    """The 12 most frequent classes and the hidden one, balanced folds, one-hot and scaling per fold, logistic
    regression; three metrics per class and fold from one table of out-of-fold probabilities."""
    pos = settle(positives(spark, d))  # read by the class choice, the folds and the targets
    top = T.topk_classes(keys(spark, d), pos, vocabulary(spark, d), "o_orderkey", 12)
    classes = [row["label"] for row in top.collect()]
    df = settle(order_cv(spark, d, classes, pos))
    found = evaluated(out_of_fold(df, "o_orderkey", classes, BASE, "log_reg", {"C": 1.0}, wide=True), METRICS, classes=classes)
    return found.withColumns({"log_loss": r("log_loss", 6), "auc": r("auc", 5), "accuracy": r("accuracy", 5)})


def embedding_cv(spark, d):
    df = feature_folds(spark, d)
    classes = [str(i) for i in range(10)]
    return df.withColumns({c: (F.col("label") == int(c)).cast("int") for c in classes}), classes


SCALED = Recipe([Scale(["c", "g"])], ["c", "g"])


# the whole search in SQL: scale outside the fold, neighbours and naive Bayes,
# log-loss per class and fold
SEARCH_SQL = [
    FEATURES,
    CELLS,
    FOLDS,
    "fold as (select distinct kfold as f from folds)",
    "raw as (select vec_id, kfold, (case grp when 'c' then 0 else 16 end) + pos as pos, v from cells join folds using (vec_id))",
    "fit as (select f, pos, avg(v) as m, stddev_pop(v) as s from fold join raw on kfold <> f group by 1, 2)",
    "z as (select f, vec_id, kfold, pos, (v - m) / s as v from raw join fit using (pos))",
    "rows as (select f, vec_id, kfold, list(v order by pos) as x from z group by 1, 2, 3)",
    "truth as (select vec_id, c as class, (label = c::int)::int as y from embeddings, (select i::varchar as c from range(10) r(i)) t)",
    "near as (select q.f, q.vec_id, t.vec_id as neighbour, row_number() over (partition by q.vec_id "
    "order by list_distance(q.x, t.x), t.vec_id) as rank from rows q join rows t on q.f = t.f and q.kfold = q.f and t.kfold <> t.f)",
    "knn as (select f, near.vec_id, class, 'knn' as clf, k as ordinal, 'n_neighbors=' || (2 * k + 2) || ',p=2' as params, "
    "sum(y) / (2 * k + 2) as p from near join truth on truth.vec_id = neighbour, range(2) t(k) where rank <= 2 * k + 2 "
    "group by 1, 2, 3, k)",
    "stats as (select f, class, y, pos, avg(v) as m, var_pop(v) as s, count(*) as n from z join truth using (vec_id) "
    "where kfold <> f group by 1, 2, 3, 4)",
    "extra as (select f, 1e-9::double * max(s) as e from (select f, pos, var_pop(v) as s from z where kfold <> f group by 1, 2) "
    "group by 1)",
    "joint as (select z.f, z.vec_id, class, y, any_value(ln(n)) - 0.5 * sum(ln(2 * pi() * (s + e)) + (v - m) * (v - m) / (s + e)) as j "
    "from z join stats using (f, pos) join extra using (f) where kfold = z.f group by 1, 2, 3, 4)",
    "nb as (select f, vec_id, class, 'nb' as clf, 0 as ordinal, 'dummy_param=None' as params, "
    "1 / (1 + exp(max(case when y = 0 then j end) - max(case when y = 1 then j end))) as p from joint group by 1, 2, 3)",
]
SCORE_SQL = (
    f"select class, clf, ordinal::int as ordinal, params, f as fold, round(avg({LOSS}), 6) as score "
    "from scored join truth using (vec_id, class) group by 1, 2, 3, 4, 5"
)


@query(
    "grid_search",
    "with recursive "
    + ", ".join(
        [
            *SEARCH_SQL,
            "matrix as materialized (select f, vec_id, kfold, list_append(x, 1.0::double) as x from rows)",
            "targets as (select vec_id, list(y order by class) as ys from truth group by 1)",
            "train as materialized (select f as part, x, ys from matrix join targets using (vec_id) where kfold <> f)",
            "models as materialized (select f || '/' || k || '/' || o as model, f as part, k, o, c::double as c from fold, "
            "range(1, 11) t(k), (values (0, 0.001), (1, 0.01)) u(o, c))",
            logistic_many_sql(64, 60),
            "lr as (select f, vec_id, (m.k - 1)::varchar as class, 'log_reg' as clf, o as ordinal, 'penalty=l2,C=' || c as params, "
            f"{proba('w', 'x')} as p from models m join weights using (model) join matrix on matrix.f = m.part where kfold = f)",
            "scored as (select * from knn union all select * from nb union all select * from lr)",
        ]
    )
    + SCORE_SQL,
)
def _(spark, d):
    """Every class; the combinations whose optimum SQL reaches."""
    df, classes = embedding_cv(spark, d)
    grid = {
        "log_reg": {"penalty": ["l2"], "C": [0.001, 0.01]},
        "knn": {"n_neighbors": [2, 4], "p": [2]},
        "nb": {"dummy_param": [None]},
    }
    found = grid_search(df, "vec_id", classes, SCALED, grid, folds_at_once=5)
    return found.withColumn("score", r("score", 6))


@query("grid_search_full")
def _(spark, d):
    """Every class with the linear, neighbour and Bayes part of the whole grid."""
    df, classes = embedding_cv(spark, d)
    grid = {clf: SEARCH_GRID[clf] for clf in ("log_reg", "knn", "nb")}
    found = grid_search(df, "vec_id", classes, SCALED, grid, folds_at_once=5)
    return found.withColumn("score", r("score", 6))


@query(
    "grid_search_exact",
    "with "
    + ", ".join([*SEARCH_SQL, "scored as (select * from knn union all select * from nb) "])
    + SCORE_SQL.replace("), 6)", "), 7)"),
)
def _(spark, d):
    df, classes = embedding_cv(spark, d)
    grid = {"knn": {"n_neighbors": [2, 4], "p": [2]}, "nb": {"dummy_param": [None]}}
    found = grid_search(df, "vec_id", classes, SCALED, grid, folds_at_once=5)
    return found.withColumn("score", r("score", 7))


MULTI_SQL = [
    "ids as (select doc_id, lang, n_chars::double as n_chars, len(string_split(text, ' '))::double as n_words, quality, toxic "
    "from documents join labels using (doc_id))",
    "pos as (select doc_id, 'quality' as label from labels where quality = 1 union all select doc_id, 'toxic' from labels where toxic = 1)",
    "counts as (select label, count(*) as n from pos group by label)",
    "strata as (select doc_id, arg_min(label, (n, label)) as stratum, string_agg(label, ',' order by label) as signature "
    "from pos join counts using (label) group by doc_id)",
    "tagged as materialized (select ids.*, cast((row_number() over (order by coalesce(stratum, ''), coalesce(signature, ''), doc_id) - 1) % 5 "
    "as integer) as kfold from ids left join strata using (doc_id))",
    "fold as (select distinct kfold as f from tagged)",
    "fit as (select f, avg(n_chars) as m1, stddev_pop(n_chars) as s1, avg(n_words) as m2, stddev_pop(n_words) as s2 "
    "from fold join tagged on kfold <> f group by f)",
    "matrix as materialized (select f, tagged.*, ["
    + ", ".join(f"(lang = '{v}')::int::double" for v in ("de", "en", "es", "fr"))
    + ", (n_chars - m1) / s1, (n_words - m2) / s2, 1.0::double] as x from tagged, fit)",
    "combos as (select f || '/' || class as model, f, class from fold, (values ('quality'), ('toxic'), ('hidden_class')) t(class))",
    "strength as (select model, 1.0::double as c from combos)",
    "train as materialized (select model, x, case class when 'quality' then quality when 'toxic' then toxic "
    "else (quality + toxic = 0)::int end as y from combos join matrix using (f) where kfold <> f)",
    logistic_sql(6, 200),
    f"p0 as (select f, doc_id, class, quality, toxic, {proba('w', 'x')} as p from combos join weights using (model) "
    "join matrix using (f) where kfold = f)",
    "p1 as (select f, doc_id, class, case class when 'quality' then quality else toxic end as y, "
    "case when p = max(p) over (partition by doc_id) then p else 0 end as p from p0)",
]


@query(
    "multilabel_cv",
    "with recursive "
    + ", ".join(MULTI_SQL)
    + f"select f as fold, round(avg(loss), 5) as score from (select f, class, avg({LOSS}) as loss from p1 "
    "where class <> 'hidden_class' group by 1, 2) group by f",
)
def _(spark, d):
    df = text_features(spark, d).join(table(spark, d, "labels"), "doc_id")
    truth = T.positives_from_wide(table(spark, d, "labels"), "doc_id", ["quality", "toxic"])
    ids = df.select("doc_id")
    folds = multilabel_stratified_kfold(ids, truth, "doc_id")
    classes = ["quality", "toxic", HIDDEN]
    y = T.ovr_targets(ids, truth, "doc_id", classes)
    df = df.drop("quality", "toxic").join(folds, "doc_id").join(y, "doc_id")
    recipe = Recipe([OneHot(["lang"]), Scale(scalars=["n_chars", "n_words"])], ["onehot", "scalars"])
    found = multilabel_cv(df, "doc_id", classes, truth, 2, recipe)
    return found.withColumn("score", r("score", 5))


@query(
    "best_params",
    with_(FOLD_SCORES, MEANS)
    + "select class, clf, arg_min(params, (mean_score, ordinal)) as params, round(min(mean_score), 9) as mean_score "
    "from means group by 1, 2",
)
def _(spark, d):
    means = R.fold_mean(fold_scores(spark, d), ["class", "clf", "ordinal", "params"])
    return R.best_params(means).withColumn("mean_score", r("mean_score", 9))


BEST_SQL = """best as (
  select class, clf, arg_min(params, (mean_score, ordinal)) as params, min(mean_score) as mean_score from means group by 1, 2)"""


@query(
    "best_classifier",
    with_(FOLD_SCORES, MEANS, BEST_SQL)
    + "select class, arg_min(clf, (mean_score, clf)) as clf, arg_min(params, (mean_score, clf)) as params, "
    "round(min(mean_score), 9) as mean_score from best group by class",
)
def _(spark, d):
    means = R.fold_mean(fold_scores(spark, d), ["class", "clf", "ordinal", "params"])
    return R.best_classifier(R.best_params(means)).withColumn("mean_score", r("mean_score", 9))


@query(
    "best_classifier_compat",
    with_(FOLD_SCORES, MEANS, BEST_SQL)
    + "select class, h.clf, h.params, h.mean_score from (select distinct class from best), "
    "(select clf, params, round(mean_score, 9) as mean_score from best where class = 'hidden_class' "
    "order by best.mean_score, clf limit 1) h",
)
def _(spark, d):
    means = R.fold_mean(fold_scores(spark, d), ["class", "clf", "ordinal", "params"])
    out = R.best_classifier(R.best_params(means), compat=True)
    return out.withColumn("mean_score", r("mean_score", 9))


@query(
    "compare_runs",
    with_(RUNS)
    + "select r.run, cast(sum((r.score - b.score < 0)::int) as bigint) as improved, count(*) as classes, "
    "round(avg(r.score - b.score), 9) as mean_diff from runs r join runs b on b.class = r.class and b.run = 'baseline' "
    "where r.run <> 'baseline' group by r.run",
)
def _(spark, d):
    return R.compare_runs(runs(spark, d), RUN_NAMES).withColumn("mean_diff", r("mean_diff", 9))


@query("greedy_feature_sets")
def _(spark, d):
    df, classes = embedding_cv(spark, d)
    df = df.withColumn("half", F.when(F.get("c", F.lit(0)) > 0, "up").otherwise("down"))
    df = df.withColumn("side", F.when(F.get("g", F.lit(0)) > 0, "left").otherwise("right"))
    roles = Roles("vec_id", ("half", "side"), ("c", "g"))
    return greedy_feature_sets(
        df, "vec_id", classes, feature_recipes(roles), "nb", {"dummy_param": None}
    )


# ---- scored output: labelled documents are the training part, the others the test part
DOC_RECIPE = Recipe(
    [OneHot(["lang", "source"]), Scale(scalars=["n_chars", "n_words"])], ["onehot", "scalars"]
)
DOC_CLASSES = ["quality", "toxic", HIDDEN]


def _documents(spark, d):
    docs, labels = text_features(spark, d), table(spark, d, "labels")
    truth = T.positives_from_wide(labels, "doc_id", ["quality", "toxic"])
    y = T.ovr_targets(labels, truth, "doc_id", DOC_CLASSES)
    return docs.join(y, "doc_id"), docs.join(labels, "doc_id", "left_anti")


DOC_SQL = [
    "docs as (select doc_id, lang, source, n_chars::double as n_chars, len(string_split(text, ' '))::double as n_words, "
    "quality, toxic from documents left join labels using (doc_id))",
    "fit as (select avg(n_chars) as m1, stddev_pop(n_chars) as s1, avg(n_words) as m2, stddev_pop(n_words) as s2 "
    "from docs where quality is not null)",
    "matrix as materialized (select docs.*, ["
    + ", ".join(f"(lang = '{v}')::int::double" for v in ("de", "en", "es", "fr"))
    + ", "
    + ", ".join(f"(source = 'src{i}')::int::double" for i in range(20))
    + ", (n_chars - m1) / s1, (n_words - m2) / s2, 1.0::double] as x from docs, fit)",
    "train as materialized (select model, x, case model when 'quality' then quality when 'toxic' then toxic "
    "else (quality + toxic = 0)::int end as y from matrix, strength where quality is not null)",
    logistic_sql(26, 200),
    f"scored as (select doc_id, model, {proba('w', 'x')} as p from matrix, weights where quality is null)",
]


def _strengths(**c: float) -> str:
    values = ", ".join(f"('{k}', {v}::double)" for k, v in c.items())
    return f"strength as (select model, c from (values {values}) t(model, c))"


@query(
    "score_baseline",
    "with recursive "
    + ", ".join([_strengths(quality=1.0, toxic=1.0, hidden_class=1.0), *DOC_SQL])
    + "select doc_id, round(max(case when model = 'quality' and p = best then p else 0 end), 4) as quality, "
    "round(max(case when model = 'toxic' and p = best then p else 0 end), 4) as toxic "
    "from (select *, max(p) over (partition by doc_id) as best from scored) group by doc_id",
)
def _(spark, d):
    train, test = _documents(spark, d)
    scored = P.score_baseline(train, test, "doc_id", DOC_CLASSES, DOC_RECIPE, tol=1e-9)
    return P.submission_wide(_rounded(scored), test, "doc_id", ["quality", "toxic"])


@query(
    "score_tuned",
    "with recursive "
    + ", ".join([_strengths(quality=0.1, toxic=1.0, hidden_class=10.0), *DOC_SQL])
    + "select doc_id, round(max(case when model = 'quality' then p end), 4) as quality, "
    "round(max(case when model = 'toxic' then p end), 4) as toxic from scored group by doc_id",
)
def _(spark, d):
    train, test = _documents(spark, d)
    strengths = {"quality": 0.1, "toxic": 1.0, HIDDEN: 10.0}
    scored = P.score_tuned(train, test, "doc_id", DOC_CLASSES, DOC_RECIPE, strengths, tol=1e-9)
    return P.submission_wide(_rounded(scored), test, "doc_id", ["quality", "toxic"])


@query(
    "drop_hidden",
    "select doc_id, label, p from (select doc_id, 'toxic' as label, round((n_chars % 101) / 100.0::double, 2) as p "
    "from documents where n_chars % 101 <> 0)",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", r(F.col("n_chars") % 101 / 100, 2).alias("p"))
    both = docs.select("doc_id", F.array(F.col("p"), 1 - F.col("p")).alias("probs"))
    return P.drop_hidden(predictions_long(both, "doc_id", ["toxic", HIDDEN]))


@query(
    "control_rows_zero",
    with_(PREDICTIONS, LONG_SQL)
    + "select doc_id, class, case when lang = 'de' then 0.0::double else p end as p from long join documents using (doc_id)",
)
def _(spark, d):
    long = _long(spark, d).select("doc_id", "class", "p")
    langs = table(spark, d, "documents").select("doc_id", "lang")
    return P.control_rows_zero(long, langs, "doc_id", F.col("lang") == "de")


@query(
    "submission_wide",
    with_(PREDICTIONS)
    + "select doc_id, coalesce(p_quality, 0)::double as quality, coalesce(p_toxic, 0)::double as toxic "
    "from documents left join predictions using (doc_id)",
)
def _(spark, d):
    long = _long(spark, d).select("doc_id", F.col("class").alias("label"), "p").filter(F.col("p") > 0)
    return P.submission_wide(long, table(spark, d, "documents"), "doc_id", ["quality", "toxic"])
