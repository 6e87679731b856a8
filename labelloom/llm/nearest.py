"""Nearest vectors by collision counting over sorted projections.

Vectors are dealt into blocks of about ``BLOCK`` rows by a hash of the id, and a
block meets a block of queries in one task. There every vector is projected on
``PROJECTIONS`` directions, and each projection is one sorted array. A query
opens a window around its own value in every array; virtual rehashing widens
all windows by ``GROWTH`` and only reads what the wider window adds. Vectors
that collide in ``SHARE`` of the arrays are candidates; once a quarter of the
block (``LEAST`` at least) are, their inner products are taken exactly. Windows
that cover the whole block verify all of it, so small tables are searched
exactly. Largest inner product is turned into smallest distance by one more
coordinate that gives all vectors the same norm.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part; lengths whose squares over- or underflow are scaled first (a product beyond the
doubles is infinite, one of infinities of both signs comes last); rows equal in id and vector count once; a row whose id
is the query's is no candidate; vectors only meet those of their dimension; ties
go to the smaller id; fewer candidates than k are all returned; no vectors, no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 8192
QUERY_BLOCK = 4096
PROJECTIONS = 64
SHARE = 0.55  # of the projections that must collide
START = 0.6  # first half-width, in standard deviations
GROWTH = 1.3
VERIFIED = 0.25  # of a block
LEAST = 1024


@lru_cache(maxsize=4)
def directions(dim: int) -> np.ndarray:
    """Orthonormal sets of random directions, PROJECTIONS columns in all."""
    rng = np.random.default_rng(dim)
    sets = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-PROJECTIONS // dim))]
    return np.hstack(sets)[:, :PROJECTIONS]


class Block:
    """The sorted arrays over one block of vectors."""

    def __init__(self, vectors: np.ndarray):
        scaled = vectors / np.abs(vectors).max()  # no square overflows; what underflows is next to zero here
        norms = np.linalg.norm(scaled, axis=1)
        top = norms.max()
        rest = np.sqrt(np.maximum(0, 1 - (norms / top) ** 2))
        values = np.column_stack([scaled / top, rest]) @ directions(vectors.shape[1] + 1)
        self.order = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(values.T, self.order, 1)
        self.width = START * float(values.std(axis=0).mean()) or 1.0
        self.vectors = vectors

    def windows(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last position per query and projection."""
        low = [np.searchsorted(s, a - half, "left") for s, a in zip(self.sorted, at.T, strict=True)]
        high = [np.searchsorted(s, a + half, "right") for s, a in zip(self.sorted, at.T, strict=True)]
        return np.array(low).T, np.array(high).T

    def candidates(self, queries: np.ndarray):
        """Yields (query, positions of its candidates)."""
        n, total = len(self.vectors), PROJECTIONS
        need, wanted = int(np.ceil(SHARE * total)), min(n, max(LEAST, int(np.ceil(VERIFIED * n))))
        unit = queries / np.abs(queries).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        at = np.column_stack([unit, np.zeros(len(queries))]) @ directions(queries.shape[1] + 1)
        active, half = np.arange(len(queries)), self.width
        low, high = self.windows(at, half)
        old_low = old_high = low
        counts = np.zeros((len(queries), n), dtype=np.uint16)
        while len(active):
            left = []
            for q in active:
                added = [o[a:b] for o, a, b in zip(self.order, low[q], old_low[q], strict=True)]
                added += [o[a:b] for o, a, b in zip(self.order, old_high[q], high[q], strict=True)]
                counts[q] += np.bincount(np.concatenate(added), minlength=n).astype(np.uint16)
                hit = np.flatnonzero(counts[q] >= need)
                if len(hit) >= wanted:
                    yield q, hit
                else:
                    left.append(q)
            active, half, old_low, old_high = np.array(left, dtype=int), half * GROWTH, low, high
            if len(active):
                low, high = self.windows(at, half)


def search_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    out: list[tuple] = []
    if len(queries) and len(rows):
        ids = rows["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.stack(rows["v"].to_numpy())[order]
        wanted, qids = np.stack(queries["v"].to_numpy()), queries["id"].to_numpy()
        block = Block(vectors)
        step = max(1, 16_000_000 // len(ids))  # bounds the collision counters
        for start in range(0, len(qids), step):
            part = wanted[start : start + step]
            for q, hit in block.candidates(part):
                hit = hit[ids[hit] != qids[start + q]]
                with np.errstate(over="ignore", invalid="ignore"):
                    score = np.einsum("ij,j->i", vectors[hit], part[q])
                score[np.isnan(score)] = -np.inf
                best = np.lexsort((ids[hit], -score))[:k]
                out.append((np.full(len(best), qids[start + q]), ids[hit][best], score[best]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
    return pd.DataFrame({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]}).astype(
        {"query_id": "int64", "vec_id": "int64", "score": "float64"}
    )


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): the vectors that take part, in double precision."""
    v = F.col(vector).cast("array<double>")
    plain = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = rows.select(F.col(key).cast("long").alias("id"), v.alias("v"))
    out = out.filter(F.coalesce(plain & F.exists(v, lambda x: x != 0), F.lit(False)) & F.col("id").isNotNull())
    return out.distinct()


def search(rows: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score); ``is_query`` is a condition on ``id``."""
    data = usable(rows, key, vector).withColumn("dim", F.size("v"))
    sizes = data.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    blocks, query_blocks = max(1, -(-sizes[0] // BLOCK)), max(1, -(-sizes[1] // QUERY_BLOCK))
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    rows_at = data.select("id", "v", "dim", place(blocks).alias("b"), everywhere(query_blocks).alias("q"))
    asked = data.filter(is_query).select("id", "v", "dim", everywhere(blocks).alias("b"), place(query_blocks).alias("q"))
    keys = ("dim", "b", "q")
    found = (
        asked.groupBy(*keys)
        .cogroup(rows_at.groupBy(*keys))
        .applyInPandas(lambda a, b: search_block(a, b, k), "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
