"""Log-loss, AUC and accuracy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelloom.functions.arrays import let, total

RANGE = 2_000_000  # distinct scores that one task ranks
RANGES = 1024  # of the score order, at most
SENT = 1_000_000  # rows whose equal scores are merged before they are sent
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
EPS = 1e-15  # fixed value: stands in for a probability of exactly 0


def cell_loss(y: Column, p: Column, eps: float | None = EPS) -> Column:
    """-(y ln p + (1-y) ln(1-p)).

    Only exact 0 and 1 are replaced (by eps and 1 - eps); other values are not
    clipped. With ``eps=None`` the logarithm of 0 is minus infinity and the
    product 0 x infinity is NaN, as in floating point.
    """
    if eps is None:
        minus_inf = F.lit(float("-inf"))
        ln_p = F.when(p == 0, minus_inf).otherwise(F.ln(p))
        ln_q = F.when(p == 1, minus_inf).otherwise(F.ln(1 - p))
    else:
        safe = F.when(p == 0, F.lit(eps)).when(p == 1, F.lit(1 - eps)).otherwise(p)
        ln_p, ln_q = F.ln(safe), F.ln(1 - safe)
    return -(y * ln_p + (1 - y) * ln_q)


def class_log_loss(
    df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p", eps: float | None = EPS
) -> DataFrame:
    """Binary log-loss per group. Without ``eps`` undefined cells (NaN) are left
    out of the mean, infinite ones are not."""
    loss = cell_loss(F.col(y), F.col(p), eps)
    if eps is None:
        loss = F.nanvl(loss, F.lit(None).cast("double"))
    return df.groupBy(*by).agg(F.avg(loss).alias("log_loss"))


def multilabel_log_loss(
    predictions: DataFrame,
    positives: DataFrame,
    key: str,
    n_rows: Column | int,
    n_labels: Column | int,
    eps: float = EPS,
) -> DataFrame:
    """Mean loss over the rows x labels matrix, from stored cells only.

    A cell absent from both sides is (y=0, p=0) and has a constant loss, so the
    dense matrix is never built: the two sparse tables meet in one full outer
    join and the remaining cells are added in closed form.
    """
    p = predictions.select(key, "label", "p")
    y = positives.select(key, "label", F.lit(1).alias("y"))
    cells = p.join(y, [key, "label"], "full_outer").select(
        F.coalesce("y", F.lit(0)).alias("y"), F.coalesce("p", F.lit(0.0)).alias("p")
    )
    stored = cells.agg(
        F.coalesce(F.sum(cell_loss(F.col("y"), F.col("p"), eps)), F.lit(0.0)).alias("s"),
        F.count(F.lit(1)).alias("c"),
    )
    size = F.lit(n_rows) * F.lit(n_labels) if isinstance(n_rows, int) else n_rows * n_labels
    default = -log(1 - eps)
    return stored.select(((F.col("s") + (size - F.col("c")) * F.lit(default)) / size).alias("log_loss"))


def log_loss_with_labels(
    df: DataFrame, probs: str, label: str, names: Sequence[str], eps: float = EPS
) -> DataFrame:
    """Multi-class log-loss over the trained classes ``names``.

    Probabilities are clipped and renormalised; a true class the model does not
    know counts as eps.
    """
    clipped = F.transform(
        F.col(probs), lambda v: F.greatest(F.least(v, F.lit(1 - eps)), F.lit(eps))
    )
    where = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(label))
    p_true = let(clipped, lambda c: F.get(c, (where - 1).cast("int")) / total(c))
    loss = -F.ln(F.when(where == 0, F.lit(eps)).otherwise(p_true))
    return df.agg(F.avg(loss).alias("log_loss"))


def order_numbers(scores: pa.Array) -> np.ndarray:
    """Whole numbers in the order of the scores: null, then negative to positive, then NaN; -0.0 is 0.0."""
    values = scores.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0
    bits = np.where(np.isnan(values), np.nan, values).view(np.int64)
    return np.where(scores.is_null().to_numpy(zero_copy_only=False), LOWEST, np.where(bits < 0, bits ^ HIGHEST, bits))


def _merged(score: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct scores, ascending, and the sums of their counts."""
    order = np.argsort(score, kind="stable")
    score = score[order]
    first = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
    return score[first], *(np.add.reduceat(c[order], first) for c in counts)


def _short(counts: np.ndarray) -> bytes:
    return counts.astype(np.uint8 if counts.max() < 256 else np.int64).tobytes()


def _long(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == n else np.int64).astype(np.int64)


def _cuts(scores: DataFrame, n: int) -> np.ndarray:
    """Where the order of ``n`` scores is cut, so that about ``RANGE`` lie between two cuts.

    Quantiles of a sample: they deal out the work and change no result.
    """
    if n <= RANGE:
        return np.zeros(0, dtype=np.int64)
    ranges = min(RANGES, -(-n // RANGE))
    some = scores.sample(fraction=min(1.0, 1000 * RANGES / n), seed=0)
    shares = [i / ranges for i in range(1, ranges)]
    found = some.agg(F.percentile_approx(scores.columns[0], shares, 10 * RANGES)).first()[0]
    return np.unique(order_numbers(pa.array(found or [], pa.float64())))


def auc(df: DataFrame, by: Sequence[str], score: str, y: str, names: Sequence[str] | None = None) -> DataFrame:
    """Area under the ROC curve per group, ties counted half.

    The order of scores is cut into ranges at quantiles (of all groups, so none
    holds many more than ``RANGE`` distinct scores). Tasks merge equal scores of
    a group and send each range its sorted scores; a range counts its own pairs,
    and the negatives of the lower ranges of a group are added from one row per
    range.

    With ``names`` score and y are arrays with an entry per name, and the name
    is the key ``class`` of ``by``.
    """
    keys = list(by) or ["__all"]
    base = df if by else df.withColumn("__all", F.lit(0))
    if names is None:
        cells = base.select(*keys, F.col(score).cast("double").alias("__s"), (F.col(y) == 1).alias("__y"))
        cuts = _cuts(cells.select("__s"), cells.count())
    else:
        truth = F.transform(F.col(y), lambda v: v == 1)
        groups = [F.lit("").alias(k) if k == "class" else F.col(k) for k in keys]
        cells = base.select(*groups, F.col(score).cast("array<double>").alias("__s"), truth.alias("__y"))
        cuts = _cuts(cells.select(F.explode("__s")), cells.count() * len(names))
    width = 1 if names is None else len(names)
    kinds = [f for f in cells.schema.fields if f.name in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)

    def sent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}
        rows = 0

        def pieces() -> Iterator[pa.RecordBatch]:
            for group, parts in held.values():
                scores, pos, neg = _merged(*map(np.concatenate, zip(*parts, strict=True)))
                ends = [0, *np.searchsorted(scores, cuts, side="left").tolist(), len(scores)]
                runs = [(i, slice(a, b)) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
                columns = {k: pa.concat_arrays([v] * len(runs)) for k, v in group.items()}
                columns["__range"] = pa.array([i for i, _ in runs], pa.int32())
                columns["__score"] = [scores[r].tobytes() for _, r in runs]
                columns["__pos"], columns["__neg"] = ([_short(c[r]) for _, r in runs] for c in (pos, neg))
                yield pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.zeros(batch.num_rows, dtype=np.int64)
            for k in keys:
                one = batch.column(k).dictionary_encode(null_encoding="encode")
                codes = np.unique(codes * len(one.dictionary) + one.indices.to_numpy(), return_inverse=True)[1]
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(codes[order]) != 0))
            given, truth = batch.column("__s"), batch.column("__y")
            if names is not None:
                given, truth = given.flatten(), truth.flatten()
                if not len(given) == len(truth) == batch.num_rows * width:
                    raise ValueError("a row has not one score and one truth per name")
            pos = truth.fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64)
            neg = 1 - truth.fill_null(True).to_numpy(zero_copy_only=False).astype(np.int64)
            scores = order_numbers(given)
            for of in np.split(order, starts[1:]):
                group = {k: batch.column(k).slice(int(of[0]), 1) for k in keys}
                for j in range(width):
                    if names is not None:
                        group = {**group, "class": pa.array([names[j]], pa.string())}
                    _, parts = held.setdefault(repr([v[0].as_py() for v in group.values()]), (group, []))
                    at = of * width + j
                    parts.append((scores[at], pos[at], neg[at]))
            rows += len(scores)
            if rows > SENT:
                yield from pieces()
                held.clear()
                rows = 0
        yield from pieces()

    def counted(table: pa.Table) -> pa.Table:
        scores = [np.frombuffer(v, np.int64) for v in table["__score"].to_pylist()]
        counts = [
            np.concatenate([_long(v, len(s)) for v, s in zip(table[c].to_pylist(), scores, strict=True)])
            for c in ("__pos", "__neg")
        ]
        _, pos, neg = _merged(np.concatenate(scores), *counts)
        below = np.cumsum(neg) - neg
        one = table.select([*keys, "__range"]).slice(0, 1)
        for name, value in (("__np", int(pos.sum())), ("__nn", int(neg.sum()))):
            one = one.append_column(name, pa.array([value], pa.int64()))
        return one.append_column("__u", pa.array([float(pos @ (below + neg / 2.0))], pa.float64()))

    ranges = cells.mapInArrow(sent, f"{schema}, __range int, __score binary, __pos binary, __neg binary").groupBy(
        *keys, "__range"
    ).applyInArrow(counted, f"{schema}, __range int, __np bigint, __nn bigint, __u double")
    lower = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    pairs = F.col("__u") + F.col("__np") * F.col("__below").cast("double")
    out = (
        ranges.withColumn("__below", F.coalesce(F.sum("__nn").over(lower), F.lit(0)))
        .groupBy(*keys)
        .agg(F.sum(pairs).alias("__u"), F.sum("__np").alias("__np"), F.sum("__nn").alias("__nn"))
    )
    return out.select(
        *by, F.try_divide(F.col("__u"), F.col("__np").cast("double") * F.col("__nn")).alias("auc")
    )


def accuracy(df: DataFrame, by: Sequence[str], y: str, predicted: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(y) == F.col(predicted)).cast("int")).alias("accuracy"))
