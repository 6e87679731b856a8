"""Penalised logistic regression as SQL, to check the fitted models against.

Minimises sum(loss) + |w|^2 / (2 C) per model (last entry of x is the intercept
and is not penalised) by steps w - B^-1 gradient with the fixed curvature bound
B = X'X / 4 + penalty; B is inverted by Newton-Schulz iteration.
"""

from __future__ import annotations


def logistic_sql(d: int, steps: int) -> str:
    """From train(model, x, y) and strength(model, c) to weights(model, w); x has d + 1 entries."""
    n = d + 1
    return f"""lr_cells as materialized (select model, row_number() over () as id, x from train),
lr_long as (select model, id, k as i, x[k] as v from lr_cells, range(1, {n + 1}) t(k)),
lr_pairs as (
  select a.model, a.i, b.i as j, sum(a.v * b.v) / 4 as s from lr_long a join lr_long b using (model, id) group by 1, 2, 3),
lr_lines as (
  select model, i, list(s + case when i = j and i <= {d} then 1 / c else 0 end order by j) as line
  from lr_pairs join strength using (model) group by 1, 2),
lr_bound as (select model, list(line order by i) as a from lr_lines group by 1),
lr_scaled as materialized (
  select model, a, pow(list_max([list_sum([abs(v) for v in r]) for r in a]), 2) as size from lr_bound),
lr_inverse as (
  select model, 0 as step, a, [[v / size for v in r] for r in a] as b from lr_scaled
  union all
  select model, step + 1, a, [[b[i][j] + b[j][i] - (list_dot_product(b[i], ab[j]) + list_dot_product(b[j], ab[i])) / 2
         for j in range(1, {n + 1})] for i in range(1, {n + 1})]
  from (select model, step, a, b, [[list_dot_product(r, s) for r in a] for s in b] as ab from lr_inverse where step < 40)),
lr_ready as materialized (select model, b from lr_inverse where step = 40),
lr_steps as (
  select model, 0 as step, [0.0::double for i in range({n})] as w from strength
  union all
  select model, step + 1, [w[i] - list_dot_product(b[i], g) for i in range(1, {n + 1})]
  from (select model, any_value(step) as step, any_value(w) as w,
               list(gk + case when k <= {d} then w[k] / c else 0 end order by k) as g
        from (select model, k, any_value(step) as step, any_value(w) as w, sum(e * xk) as gk
              from (select model, step, w, e, unnest(x) as xk, generate_subscripts(x, 1) as k
                    from (select s.model, s.step, s.w, t.x, 1 / (1 + exp(-list_dot_product(s.w, t.x))) - t.y as e
                          from lr_steps s join train t on t.model = s.model where s.step < {steps}))
              group by model, k) join strength using (model)
        group by model) join lr_ready using (model)),
weights as (select model, w from lr_steps where step = {steps})"""


def logistic_many_sql(d: int, steps: int) -> str:
    """The same for many models that share rows: from train(part, x, ys) and models(model, part, k, c) to
    weights(model, w); model ``model`` learns ``ys[k]`` on the rows of its part. The bound is inverted once for
    every (part, c)."""
    n = d + 1
    gradient = ", ".join(f"sum(e * x[{i}])" + (f" + w[{i}] / c" if i <= d else "") for i in range(1, n + 1))
    pairs = ", ".join("[" + ", ".join(f"sum(x[{i}] * x[{j}]) / 4" for j in range(1, n + 1)) + "]" for i in range(1, n + 1))
    return f"""lm_cross as materialized (select part, [{pairs}] as a from train group by part),
lm_bound as (
  select part, c, [[a[i][j] + case when i = j and i <= {d} then 1 / c else 0 end for j in range(1, {n + 1})] for i in range(1, {n + 1})] as a
  from lm_cross join (select distinct part, c from models) using (part)),
lm_scaled as materialized (select *, pow(list_max([list_sum([abs(v) for v in r]) for r in a]), 2) as size from lm_bound),
lm_inverse as (
  select part, c, 0 as step, a, [[v / size for v in r] for r in a] as b from lm_scaled
  union all
  select part, c, step + 1, a, [[b[i][j] + b[j][i] - (list_dot_product(b[i], ab[j]) + list_dot_product(b[j], ab[i])) / 2
         for j in range(1, {n + 1})] for i in range(1, {n + 1})]
  from (select part, c, step, a, b, [[list_dot_product(r, s) for r in a] for s in b] as ab from lm_inverse where step < 40)),
lm_ready as materialized (select part, c, b from lm_inverse where step = 40),
lm_steps as (
  select model, part, k, c, 0 as step, [0.0::double for i in range({n})] as w from models
  union all
  select model, part, k, c, step + 1, [w[i] - list_dot_product(b[i], g) for i in range(1, {n + 1})]
  from (select model, part, k, c, step, w, [{gradient}] as g
        from (select s.*, t.x, 1 / (1 + exp(-list_dot_product(s.w, t.x))) - t.ys[s.k] as e
              from lm_steps s join train t on t.part = s.part where s.step < {steps})
        group by model, part, k, c, step, w) join lm_ready using (part, c)),
weights as (select model, part, k, w from lm_steps where step = {steps})"""


def proba(w: str, x: str) -> str:
    return f"(1 / (1 + exp(-list_dot_product({w}, {x}))))"


def softmax_sql(d: int, classes: int, steps: int) -> str:
    """Multinomial form: from train(id, label, x) and penalty(c) to weights(label, w).

    The curvature of every class block is bounded by X'X / 2 + penalty.
    """
    n = d + 1
    return f"""sm_long as materialized (select id, k as i, x[k] as v from train, range(1, {n + 1}) t(k)),
sm_pairs as (select a.i, b.i as j, sum(a.v * b.v) / 2 as s from sm_long a join sm_long b using (id) group by 1, 2),
sm_lines as (
  select i, list(s + case when i = j and i <= {d} then 1 / c else 0 end order by j) as line from sm_pairs, penalty group by 1),
sm_bound as materialized (select list(line order by i) as a from sm_lines),
sm_inverse as (
  select 0 as step, a, [[v / pow(list_max([list_sum([abs(u) for u in q]) for q in a]), 2) for v in r] for r in a] as b from sm_bound
  union all
  select step + 1, a, [[b[i][j] + b[j][i] - (list_dot_product(b[i], ab[j]) + list_dot_product(b[j], ab[i])) / 2
         for j in range(1, {n + 1})] for i in range(1, {n + 1})]
  from (select step, a, b, [[list_dot_product(r, s) for r in a] for s in b] as ab from sm_inverse where step < 40)),
sm_ready as materialized (select b from sm_inverse where step = 40),
sm_steps as (
  select 0 as step, label, [0.0::double for i in range({n})] as w from range({classes}) t(label)
  union all
  select step + 1, label, [w[i] - list_dot_product(b[i], g) for i in range(1, {n + 1})]
  from (select label, any_value(step) as step, any_value(w) as w,
               list(gk + case when k <= {d} then w[k] / c else 0 end order by k) as g
        from (select label, k, any_value(step) as step, any_value(w) as w, sum(e * xk) as gk
              from (select label, step, w, e, unnest(x) as xk, generate_subscripts(x, 1) as k
                    from (select s.label, s.step, s.w, t.x, exp(list_dot_product(s.w, t.x)) /
                                 sum(exp(list_dot_product(s.w, t.x))) over (partition by t.id) - (t.label = s.label)::int as e
                          from sm_steps s, train t where s.step < {steps}))
              group by label, k), penalty
        group by label), sm_ready),
weights as materialized (select label, w from sm_steps where step = {steps})"""
