"""Exact k nearest neighbours by blocks."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelloom.roles import named

BLOCK_ROWS = 2048  # rows of a block at least
MOST_ROWS = 16384  # and at most, so that a task stays small
PAIRS = 64  # pairs of blocks looked for in between
TILE = 128  # queries whose distances to a block are held at a time
FOLD = 16  # distances that share one place in the first look for the nearest
CHUNK = 8192  # pairs measured at a time


def _sums(x: np.ndarray, y: np.ndarray, p: float) -> np.ndarray:
    """Sum of the p-th powers over the first axis; what is not a number counts as infinite."""
    d = np.zeros(np.broadcast_shapes(x.shape[1:], y.shape[1:]))
    for a, b in zip(x, y, strict=True):
        d += np.abs(b - a) ** p
    d[np.isnan(d)] = np.inf
    return d


def _first_look(low: np.ndarray, k: int) -> np.ndarray:
    """k columns of every row with small values: the least of each of the k best folds, or the k least."""
    n, m = low.shape
    g = m // FOLD
    if g <= k:
        return np.argpartition(low, k - 1, axis=1)[:, :k]
    folds = np.argpartition(low[:, : g * FOLD].reshape(n, FOLD, g).min(axis=1), k - 1, axis=1)[:, :k]
    columns = folds[:, :, None] + g * np.arange(FOLD)
    inside = low[np.arange(n)[:, None, None], columns].argmin(axis=2)
    return np.take_along_axis(columns, inside[:, :, None], axis=2)[:, :, 0]


def nearest_rows(x: np.ndarray, y: np.ndarray, k: int, p: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of y, row of x, sum of p-th powers): the k nearest rows of ``x`` for every row of ``y``, ties to the smaller row.

    A matrix product gives a lower bound of every squared Euclidean distance,
    rounding included, and with it one of the sum of p-th powers. Any k rows of
    ``x`` bound the k-th distance from above, and only pairs whose lower bound
    is within that are measured term by term. Pairs without a bound (not
    finite) are always measured.
    """
    k, dim = min(k, len(x)), x.shape[1]
    xt, yt = x.T.copy(), y.T.copy()
    spread = dim ** (1 - 2 / p) if p > 2 else 1.0  # between the Euclidean and the p-distance
    slack = 1 - 8 * (dim + 8) * np.finfo(float).eps
    out = []
    with np.errstate(all="ignore"):
        x2, y2 = slack * (x * x).sum(axis=1), slack * (y * y).sum(axis=1)
        for start in range(0, len(y), TILE):
            at = np.arange(start, min(start + TILE, len(y)))
            low = (-2 * y[at]) @ xt
            low += y2[at, None]
            low += x2
            limit = _sums(xt[:, _first_look(low, k)], yt[:, at, None], p).max(axis=1)
            near = np.flatnonzero(~(low > (spread * limit ** (2 / p) * (1 + 1e-9))[:, None]))
            found = []
            for c in range(0, len(near), CHUNK):
                qi, ti = np.divmod(near[c : c + CHUNK], len(x))
                if p == 3:  # by products first, as powers are slow
                    d = x[ti]
                    d -= y[at[qi]]
                    rough = ~(np.einsum("ij,ij,ij->i", d, d, np.abs(d)) > limit[qi] * (1 + 1e-9))
                    qi, ti = qi[rough], ti[rough]
                d = _sums(xt[:, ti], yt[:, at[qi]], p)
                met = d <= limit[qi]
                found.append((qi[met], ti[met], d[met]))
            qi, ti, d = (np.concatenate(v) for v in zip(*found, strict=True))
            order = np.lexsort((ti, d, qi))
            order = order[np.searchsorted(qi[order], np.arange(len(at)))[:, None] + np.arange(k)].ravel()
            out.append((at[qi[order]], ti[order], d[order]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def block_size(n_train: int, n_query: int) -> int:
    """Rows per block: enough pairs of blocks for the cluster, and few copies of every row."""
    return min(MOST_ROWS, max(BLOCK_ROWS, int((n_train * n_query / PAIRS) ** 0.5)))


def neighbours(
    train: DataFrame,
    queries: DataFrame,
    key: str,
    column: str,
    k: int,
    p: float = 2,
    block_rows: int | None = None,
) -> DataFrame:
    """(key, neighbour, distance, rank) with rank 1..k, ties by the smaller key.

    Both sides are hashed into blocks of about ``block_rows`` rows (by default
    as large as a task may be once there are enough pairs of blocks); each pair
    of blocks is one task-sized numpy job that returns k rows per query. No
    pair of rows is ever emitted, memory per task is two blocks and some
    rows of their distance matrix, and the result does not depend on the blocking. A
    distance that is not a number counts as infinite, so every query keeps its
    k rows.
    """
    n_train, n_query = train.count(), queries.count()
    if block_rows is None:
        block_rows = block_size(n_train, n_query)
    a, b = max(1, ceil(n_train / block_rows)), max(1, ceil(n_query / block_rows))
    key_type = train.schema[key].dataType.simpleString()

    def side(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        hashed = df.select(
            named(key).alias("id"),
            named(column).alias("x"),
            F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int").alias(own),
        )
        return hashed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    def block(t: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if t.empty or q.empty:
            return pd.DataFrame({"key": [], "neighbour": [], "distance": []})
        t = t.sort_values("id", kind="stable")
        x, y = (np.vstack(s.to_numpy()).astype(float) for s in (t["x"], q["x"]))
        kk = min(k, len(x))
        qi, ti, d = nearest_rows(x, y, kk, p)
        near = pd.DataFrame({"key": q["id"].to_numpy()[qi], "neighbour": t["id"].to_numpy()[ti], "distance": d})
        return near.sort_values(["key", "distance", "neighbour"]).groupby("key").head(kk)

    left = side(train, "ta", a, "qb", b).groupBy("ta", "qb")
    right = side(queries, "qb", b, "ta", a).groupBy("ta", "qb")
    found = left.cogroup(right).applyInPandas(
        block, f"key {key_type}, neighbour {key_type}, distance double"
    )
    order = Window.partitionBy("key").orderBy("distance", "neighbour")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(
        F.col("key").alias(key),
        "neighbour",
        F.pow("distance", F.lit(1.0 / p)).alias("distance"),
        "rank",
    )


def knn_proba(near: DataFrame, positives: DataFrame, key: str, k: int) -> DataFrame:
    """(key, class, p): share of the k neighbours holding the class, zero shares omitted.

    Neighbours do not depend on the class, so one search serves all of them.
    """
    votes = positives.select(F.col(key).alias("neighbour"), F.col("label").alias("class"))
    held = near.filter(F.col("rank") <= k).select(key, "neighbour").join(votes, "neighbour")
    return held.groupBy(key, "class").agg((F.count(F.lit(1)) / F.lit(k)).alias("p"))
