"""Approximate k nearest neighbours for p = 2 by p-stable hash tables with multi-probe."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelloom.models.neighbours import BLOCK_ROWS, nearest_rows, neighbours
from labelloom.operators.joins import lookup_join
from labelloom.roles import named
from labelloom.session import settle

SAMPLE = 2000  # training rows the cell width is fitted on
ASKED = 256  # of them are queries
WIDTHS = (0.5, 0.75, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 6.0)  # over the median distance to the k-th neighbour
PAIRS = 1 << 20  # distances held at a time; one bucket of one query may exceed it by block_rows
CHUNK = 1024  # vectors probed at a time
DENSE = 4096  # pairs of a bucket from which on it is searched by matrix products


@lru_cache(maxsize=4)
def _tables(dim: int, tables: int, hashes: int, seed: int):
    """Gaussian directions, offsets (in cells) and the odd factors that mix the cells of a table into one bucket."""
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(dim, tables * hashes))
    offsets = rng.random(tables * hashes)
    factors = rng.integers(-(2**62), 2**62, size=(tables, hashes)) * 2 + 1
    return directions, offsets, factors


@lru_cache(maxsize=4)
def _steps(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Probes: one cell down (0 .. hashes - 1) or up (hashes ..), alone or two of different directions.
    ``2 * hashes`` stands for no second step."""
    moves = range(2 * hashes)
    pairs = [(i, 2 * hashes) for i in moves]
    pairs += [(i, j) for i, j in combinations(moves, 2) if (i - j) % hashes]
    first, second = zip(*pairs, strict=True)
    return np.array(first), np.array(second)


def buckets(x: np.ndarray, width: float, tables: int, hashes: int, probes: int = 0, seed: int = 0) -> np.ndarray:
    """Bucket of every vector per table, followed by the ``probes`` buckets most likely to hold
    what fell just over a cell border: rows x tables x (1 + probes)."""
    directions, offsets, factors = _tables(x.shape[1], tables, hashes, seed)
    at = ((x / width) @ directions + offsets).reshape(len(x), tables, hashes)
    cell = np.floor(at)
    with np.errstate(invalid="ignore", over="ignore"):
        own = (cell.astype(np.int64) * factors).sum(axis=2)[:, :, None]
    if not probes:
        return own
    down = at - cell
    first, second = _steps(hashes)
    none = np.zeros((*down.shape[:2], 1))
    cost = np.concatenate([down**2, (1 - down) ** 2, none], axis=2)
    score = cost[:, :, first] + cost[:, :, second]
    taken = np.argpartition(score, min(probes, len(first)) - 1, axis=2)[:, :, :probes]
    step = np.concatenate([-factors, factors, np.zeros((tables, 1), dtype=np.int64)], axis=1)
    shift = step[:, first] + step[:, second]
    return np.concatenate([own, own + np.take_along_axis(shift[None], taken, axis=2)], axis=2)


def _hashed(width: float, tables: int, hashes: int, probes: int, seed: int):
    def of(column: pd.Series) -> pd.Series:
        out: list[np.ndarray] = []
        for start in range(0, len(column), CHUNK):
            x = np.vstack(column.iloc[start : start + CHUNK].to_numpy())
            out.extend(buckets(x, width, tables, hashes, probes, seed).reshape(len(x), -1))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(of, "array<long>")


def cell_width(train: DataFrame, k: int, recall: float, tables: int, hashes: int, probes: int, seed: int) -> float:
    """The least cell width of ``WIDTHS`` at which the sample finds ``recall`` of its own neighbours.

    The sample holds at most ``SAMPLE`` training rows, the first by a hash of the
    key, and ``ASKED`` of them are queries. Neighbours in a sample are farther
    than among all rows, so the width errs on the side of finding more.
    """
    rows = train.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").toPandas()["x"]
    if len(rows) < 2:
        return 1.0
    x = np.vstack(rows.to_numpy())
    scale = float(np.abs(x).max()) or 1.0
    x = x / scale  # so that no square overflows
    asked, kk = x[:ASKED], min(k, len(x) - 1)
    norms = (x**2).sum(axis=1)
    squares = np.maximum(norms[: len(asked), None] + norms[None] - 2 * asked @ x.T, 0)
    squares[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argpartition(squares, kk - 1, axis=1)[:, :kk]
    far = np.sqrt(np.take_along_axis(squares, near, axis=1).max(axis=1))
    far = far[far > 1e-7]
    if not len(far):
        return scale
    typical = float(np.median(far))
    for factor in WIDTHS:
        own = buckets(x, factor * typical, tables, hashes, 0, seed)[near]  # query, neighbour, table, 1
        seen = buckets(asked, factor * typical, tables, hashes, probes, seed)[:, None]
        if (own == seen).any(axis=(2, 3)).mean() >= recall:
            break
    return factor * typical * scale


def _first_per_query(found: pd.DataFrame, k: int) -> pd.DataFrame:
    found = found.drop_duplicates(["key", "neighbour"]).sort_values(["key", "distance", "neighbour"])
    return found.groupby("key").head(k)


def _nearest_of_cell(t: pd.DataFrame, q: pd.DataFrame, k: int) -> pd.DataFrame:
    """(key, neighbour, squared distance): the k nearest of every query among the rows of this cell
    that share one of its buckets. Buckets of ``DENSE`` pairs are searched by matrix products, the pairs of
    smaller ones are measured together, about ``PAIRS`` distances at a time."""
    kept = pd.DataFrame({"key": q["id"].iloc[:0], "neighbour": q["id"].iloc[:0], "distance": np.zeros(0)})
    if t.empty or q.empty:
        return kept
    t, q = t.sort_values(["bucket", "id"]), q.sort_values("bucket", kind="stable")
    held, wanted = t["bucket"].to_numpy(), q["bucket"].to_numpy()
    low, high = np.searchsorted(held, wanted, "left"), np.searchsorted(held, wanted, "right")
    x, y = np.vstack(t["x"].to_numpy()), np.vstack(q["x"].to_numpy())
    t_id, q_id = t["id"].to_numpy(), q["id"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], wanted[1:] != wanted[:-1]]))
    stops = np.concatenate([starts[1:], [len(wanted)]])
    large = np.flatnonzero((stops - starts) * (high - low)[starts] >= DENSE)
    parts, small = [], np.ones(len(q), dtype=bool)
    for a, b in zip(starts[large], stops[large], strict=True):
        qi, ti, d = nearest_rows(x[low[a] : high[a]], y[a:b], k, 2)
        parts.append(pd.DataFrame({"key": q_id[a + qi], "neighbour": t_id[low[a] + ti], "distance": d}))
        small[a:b] = False
    if parts:
        kept = _first_per_query(pd.concat(parts), k)
    q_id, low, high, y = q_id[small], low[small], high[small], y[small]
    x, y = x.T.copy(), y.T.copy()
    ends = np.cumsum(high - low)
    start = 0
    while start < len(q_id):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        n = (high - low)[start:stop]
        qi = np.repeat(np.arange(start, stop), n)
        ti = np.arange(len(qi)) - np.repeat(ends[start:stop] - n - done, n) + np.repeat(low[start:stop], n)
        d = np.zeros(len(qi))
        for a, b in zip(x, y, strict=True):
            d += (b[qi] - a[ti]) ** 2
        found = pd.DataFrame({"key": q_id[qi], "neighbour": t_id[ti], "distance": d})
        kept = _first_per_query(pd.concat([kept, found]) if len(kept) else found, k)
        start = stop
    return kept


def knn_lsh(
    train: DataFrame, queries: DataFrame, key: str, column: str, k: int,
    recall: float = 0.95, tables: int = 8, hashes: int = 10, probes: int = 30, seed: int = 0, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(key, neighbour, distance, rank) as ``neighbours`` with p = 2, found among the rows that share a bucket.

    Keys are unique. Every training row has one bucket per table; a query looks into its own and
    the ``probes`` buckets whose borders it is closest to. The cell width follows
    from ``recall`` on a bounded sample (``cell_width``). Buckets are dealt
    into cells, one task-sized job each, which returns k rows per query; a
    bucket of more than ``block_rows`` rows is split on both sides, and all its
    splits meet. Equal vectors are searched once, and of equal training vectors
    only the k smallest keys can be neighbours, so copies do not fill a bucket.

    Distances are exact and ties go to the smaller key. A query that meets fewer
    than k rows, or holds a null or NaN, is answered by the exact search, so
    every query keeps its k rows. Rows without key or vector take no part; a
    training row with a null or NaN inside is only found by the exact search.
    """
    if k < 1 or tables < 1 or hashes < 1 or probes < 0:
        raise ValueError("k, tables and hashes must be positive and probes not negative")
    given = [
        df.select(named(key).alias("id"), named(column).cast("array<double>").alias("x")).filter(
            "id is not null and x is not null"
        )
        for df in (train, queries)
    ]
    plain = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows, asked = [df.filter(plain) for df in given]
    rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("x").orderBy("id")))
    rows = settle(rows.filter(F.col("__nth") <= k).drop("__nth"))
    # copies of a query vector follow the smallest of their keys
    asked = asked.join(asked.groupBy("x").agg(F.min("id").alias("rep")), "x")
    asked = settle(asked.select("id", "x", "rep"))
    distinct = asked.filter(F.col("id") == F.col("rep")).select("id", "x").dropDuplicates(["id"])

    width = cell_width(rows, k, recall, tables, hashes, probes, seed)
    cells = max(1, -(-rows.count() * tables // block_rows))

    def placed(df: DataFrame, extra: int) -> DataFrame:
        hashed = _hashed(width, tables, hashes, extra, seed)(F.col("x"))
        return df.select("id", "x", F.explode(F.array_distinct(hashed)).alias("bucket"))

    left, right = placed(rows, 0), placed(distinct, probes)

    def splits(df: DataFrame, name: str) -> DataFrame:
        n = F.count(F.lit(1))
        counted = df.groupBy("bucket").agg(F.ceil(n / block_rows).cast("int").alias(name))
        return counted.filter(F.col(name) > 1)

    hot = splits(left, "n_t").join(splits(right, "n_q"), "bucket", "full_outer")
    hot = settle(hot.select("bucket", F.coalesce("n_t", F.lit(1)).alias("n_t"), F.coalesce("n_q", F.lit(1)).alias("n_q")))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        held = lookup_join(df, hot, "bucket")
        share: Column = F.pmod(F.xxhash64("id", F.lit(1)), F.coalesce(own, F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        cell = F.pmod(F.xxhash64("bucket"), F.lit(cells))
        return held.select("id", "x", "bucket", cell.alias("cell"), share.alias(own), every.alias(other))

    places = ("cell", "n_t", "n_q")
    key_type = train.schema[key].dataType.simpleString()
    found = (
        dealt(left, "n_t", "n_q").groupBy(*places)
        .cogroup(dealt(right, "n_q", "n_t").groupBy(*places))
        .applyInPandas(lambda t, q: _nearest_of_cell(t, q, k), f"key {key_type}, neighbour {key_type}, distance double")
    )
    order = Window.partitionBy("key").orderBy("distance", "neighbour")
    found = found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    found = settle(found.join(asked.select("id", F.col("rep").alias("key")).distinct(), "key").drop("key"))
    full = found.groupBy("id").agg(F.max("rank").alias("n")).filter(F.col("n") == k)
    out = found.join(full, "id", "left_semi").select(
        F.col("id").alias(key), "neighbour", F.sqrt("distance").alias("distance"), "rank"
    )
    rest = given[1].join(full, "id", "left_anti")
    if rest.isEmpty():
        return out
    exact = neighbours(given[0], rest, "id", "x", k, 2)
    return out.unionByName(exact.withColumnRenamed("id", key))
