"""Whitening of embeddings: quantised vectors, singular directions of the centred rows, scores per row.

The fit list (each distinct quantised vector once) is written once; its exact
sums give the mean. Centred rows are reduced blockwise by QR: a task folds its
batches into one triangle, triangles are folded ``FAN`` at a time until one is
left, so no task sees more than ``FAN`` triangles of d x d. Their covariance is
never formed, which would square the condition number. The triangle is made
bidiagonal by Householder reflections, dqds finds its singular values to high
relative accuracy and a twisted factorisation gives each value's vector; the
whitening direction is that vector over the root of its eigenvalue.

Vectors: a null vector, an empty one and one with a null or non-finite entry
take no part, nor does one with an entry that leaves ``LIMIT`` after
quantisation, or with another number of entries than most vectors of the table
have (ties: the larger number). Repeated rows and equal ids all get scores. A
direction without variance has ``whitened`` null and ``explained`` 0 and no
part in ``identity_error``. ``deviation`` is null where it exceeds a long.
Other columns of the table play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.session import settle

SCALE, SHIFT = 64, 1_000_000  # fixed by the definition of the quantised vector
LIMIT = 2**45  # exact as a double, and sums of a batch stay within a long
FAN = 32  # triangles folded in one task
EPS = np.finfo(float).eps


def quantised(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    entry = F.col("v")
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(
        # NaN is greater than any number here
        (F.size(entry) > 0) & F.forall(entry, lambda c: F.coalesce(F.abs(c) <= LIMIT / SCALE, F.lit(False)))
    )
    x = F.transform(entry, lambda c: F.floor(c * SCALE) + SHIFT)
    return rows.select("vec_id", x.cast("array<long>").alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _batch_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for batch in batches:
        if batch.num_rows:
            sums = matrix(batch.column("x")).sum(axis=0)
            same = np.ones(len(sums), dtype=np.int64)
            yield pa.RecordBatch.from_pydict(
                {"part": same * part, "n": same * batch.num_rows, "dim": np.arange(len(sums)), "total": sums}
            )


class Centre:
    """Exact mean S / n of integer vectors: whole part and remainder. ``slices``: partitions they lie in."""

    def __init__(self, n: int, sums: list[int], slices: int):
        self.n, self.slices = n, slices
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([s % n for s in sums], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) squared, in whole numbers."""
        shifted = x - self.whole
        bound = (int(np.abs(shifted).max(initial=0)) + 1) * self.n
        if bound * bound * x.shape[1] >= 2**63:
            exact = ((shifted.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(axis=1)
            return [int(v) if v < 2**63 else None for v in exact]
        return ((shifted * self.n - self.rest) ** 2).sum(axis=1).tolist()


def fit_sums(fit: DataFrame) -> Centre | None:
    """Row count and sums, one row per dimension."""
    found = (
        fit.mapInArrow(_batch_sums, "part long, n long, dim long, total long")
        .groupBy("dim")
        .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.max("part").alias("last"))
        .orderBy("dim")
        .collect()
    )
    return Centre(found[0]["n"], [int(r["total"]) for r in found], found[0]["last"] + 1) if found else None


def triangle(blocks: Iterable[np.ndarray], d: int) -> np.ndarray:
    """R of the blocks on top of each other, one block at a time."""
    return reduce(lambda r, block: np.linalg.qr(np.vstack([r, block]), mode="r"), blocks, np.zeros((0, d)))


def reduced(fit: DataFrame, centre: Centre) -> np.ndarray:
    """The triangle of all centred rows."""
    d, slices = len(centre.whole), centre.slices

    def fold_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = triangle((centre.centred(matrix(b.column("x"))) for b in batches if b.num_rows), d)
        if len(r):
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "r": pa.array([r.ravel().tolist()])})

    def fold_triangles(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("part")
        r = triangle((np.asarray(v).reshape(-1, d) for v in parts["r"]), d)
        return pd.DataFrame({"part": parts["part"].iloc[:1] // FAN, "r": [r.ravel().tolist()]})

    found = fit.mapInArrow(fold_rows, "part long, r array<double>")
    while slices > 1:
        found = found.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(fold_triangles, "part long, r array<double>")
        slices = -(-slices // FAN)
    r = np.asarray(found.first()["r"]).reshape(-1, d)
    return np.vstack([r, np.zeros((d - len(r), d))])


def _reflector(x: np.ndarray) -> np.ndarray:
    """Unit vector whose reflection maps ``x`` onto its first axis (zeros: none)."""
    size = np.abs(x).max(initial=0.0)
    if size == 0.0:
        return np.zeros_like(x)
    v = x / size
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    return v / np.linalg.norm(v)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right transformation V of r = U B V^T, by Householder reflections."""
    b, d = r.copy(), len(r)
    v = np.eye(d)
    for k in range(d):
        u = _reflector(b[k:, k])
        b[k:, k:] -= 2.0 * np.outer(u, u @ b[k:, k:])
        if k + 2 < d:
            w = _reflector(b[k, k + 1 :])
            b[k:, k + 1 :] -= 2.0 * np.outer(b[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2.0 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(b).copy(), np.diag(b, 1).copy(), v


def _shifted(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """One dqds transform; None if the shift is beyond the smallest value."""
    nq, ne = np.empty_like(q), np.empty_like(e)
    d = q[0] - shift
    for i in range(len(e)):
        if d < 0.0 or (nq_i := d + e[i]) <= 0.0:
            return None
        t = q[i + 1] / nq_i
        nq[i], ne[i] = nq_i, e[i] * t
        d = d * t - shift
    nq[-1] = d
    return None if d < 0.0 else (nq, ne)


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling.

    A shift is proved by its own transform: all pivots stay positive only below
    the smallest value. Tried are the Rayleigh quotient of the last place less
    its residual and parts of it, then no shift.
    """
    found: list[float] = []
    work = [(diagonal**2, above**2, 0.0)]
    while work:
        q, e, base = work.pop()
        if not len(q):
            continue
        if len(q) == 1:
            found.append(q[0] + base)
            continue
        tiny = (EPS * EPS) * np.minimum(q[:-1], q[1:]) + np.finfo(float).tiny
        small = np.flatnonzero(e <= np.maximum(tiny, EPS * EPS * base))
        if len(small):
            cut = small[-1]
            work += [(q[: cut + 1], e[:cut], base), (q[cut + 1 :], e[cut + 1 :], base)]
            continue
        if q[0] < q[-1]:  # the small end belongs below
            q, e = q[::-1].copy(), e[::-1].copy()
        low = q[-1] + e[-1] - np.sqrt(q[-2] * e[-1])
        for shift in (low * (1.0 - 4 * EPS), 0.9 * low, 0.5 * low, 0.25 * q.min(), 0.0):
            if shift >= 0.0 and (step := _shifted(q, e, shift)):
                work.append((*step, base + shift))
                break
    return np.sort(np.array(found))[::-1]


def _twisted(diagonal: np.ndarray, ratio: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gamma, lower, upper) of B^T B - value: its top-down and bottom-up factorisations and where they meet."""
    d, n = diagonal**2, len(diagonal)
    s, p = np.empty(n), np.empty(n)
    lower, upper = np.empty(n - 1), np.empty(n - 1)
    guard = np.finfo(float).tiny / EPS
    s[0] = -value
    for i in range(n - 1):
        if ratio[i] == 0.0:  # the matrix falls apart here
            lower[i], s[i + 1] = 0.0, -value
            continue
        pivot = s[i] + d[i]
        pivot = pivot if abs(pivot) > guard else guard
        lower[i] = d[i] * ratio[i] / pivot
        s[i + 1] = lower[i] * ratio[i] * s[i] - value
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        if ratio[i] == 0.0:
            upper[i], p[i] = 0.0, d[i] - value
            continue
        pivot = d[i] * ratio[i] ** 2 + p[i + 1]
        pivot = pivot if abs(pivot) > guard else guard
        t = d[i] / pivot
        upper[i] = ratio[i] * t
        p[i] = p[i + 1] * t - value
    return s + p + value, lower, upper


def singular_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors (columns) for squared singular values ``values``, falling.

    The twist is where the two factorisations fit best. Vectors of values that
    are close together are made orthogonal to each other; if little is left of
    one, the next best twist is taken.
    """
    floor = (np.abs(diagonal).max(initial=0.0) or 1.0) * EPS * EPS
    diagonal = np.where(np.abs(diagonal) > floor, diagonal, floor)
    size = np.abs(diagonal)
    ratio = np.where(np.abs(above) > EPS / 8 * np.minimum(size[:-1], size[1:]), above, 0.0) / diagonal[:-1]
    n, out = len(diagonal), np.zeros((len(diagonal), len(values)))
    for j, value in enumerate(values):
        gamma, lower, upper = _twisted(diagonal, ratio, value)
        near = out[:, :j][:, np.abs(values[:j] - value) <= 1e-3 * np.abs(values[:j])]
        best = 0.0
        for k in np.argsort(np.where(np.isfinite(gamma), np.abs(gamma), np.inf), kind="stable"):
            z = np.zeros(n)
            z[k] = 1.0
            for i in range(k - 1, -1, -1):
                z[i] = -lower[i] * z[i + 1]
            for i in range(k, n - 1):
                z[i + 1] = -upper[i] * z[i]
            z /= np.linalg.norm(z)
            rest = z - near @ (near.T @ z)
            rest -= near @ (near.T @ rest)
            if (left := np.linalg.norm(rest)) > best:
                best, out[:, j] = left, rest / left
            if best > 0.1:
                break
    return out


class Whitening:
    """``directions`` (d x k) project a centred row; ``values`` are eigenvalues, ``explained`` their shares."""

    def __init__(self, centre: Centre, r: np.ndarray, most: int):
        scale = np.abs(r).max(initial=0.0) or 1.0
        diagonal, above, v = bidiagonal(r / scale)
        squares = dqds(diagonal, above)
        kept = squares[: min(most, len(squares))]
        live = kept > (16 * len(r) * EPS) ** 2 * squares[0]
        self.centre, self.live = centre, live
        self.values = kept * scale**2 / centre.n
        self.explained = np.where(live, kept / max(np.square(r / scale).sum(), np.finfo(float).tiny), 0.0)
        axes = v @ singular_vectors(diagonal, above, kept[live])
        self.directions = axes / np.sqrt(self.values[live])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.directions


def fitted(fit: DataFrame, most: int) -> Whitening | None:
    centre = fit_sums(fit)
    return Whitening(centre, reduced(fit, centre), most) if centre else None


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the scores' covariance over the fit list minus the identity."""
    k = int(model.live.sum())
    if not k:
        return 0.0

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, total = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            if b.num_rows:
                z = model.scores(matrix(b.column("x")))
                gram += z.T @ z
                total += z.sum(axis=0)
        cells = np.concatenate([gram.ravel(), total])
        yield pa.RecordBatch.from_pydict({"cell": np.arange(len(cells)), "value": cells})

    cells = fit.mapInArrow(products, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    found = np.array([r["value"] for r in cells.orderBy("cell").collect()])
    mean = found[k * k :] / model.centre.n
    return float(np.abs(found[: k * k].reshape(k, k) / model.centre.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(table: DataFrame, vec_id: str, vector: str, most: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), up to ``most`` rows per vector."""
    rows = quantised(table, vec_id, vector)
    widths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d"))
    if (usual := widths.first()) is not None:
        rows = rows.filter(F.size("x") == usual["d"])
    fit = settle(rows.select("x").distinct())
    model = fitted(fit, most)
    schema = "vec_id {}, deviation long, scores array<struct<whitened: double, explained: double>>".format(
        rows.schema["vec_id"].dataType.simpleString()
    )
    if model is None:
        scored, n, error = table.sparkSession.createDataFrame([], schema), 0, 0.0
    else:
        n, error = model.centre.n, identity_error(fit, model)

        def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair = pa.struct([("whitened", pa.float64()), ("explained", pa.float64())])
            for b in batches:
                x = matrix(b.column("x")) if b.num_rows else np.zeros((0, len(model.centre.whole)), np.int64)
                z = np.full((len(x), len(model.live)), np.nan)
                z[:, model.live] = model.scores(x)
                flat = pa.StructArray.from_arrays(
                    [
                        pa.array(z.ravel(), mask=np.isnan(z.ravel())),
                        pa.array(np.tile(model.explained, len(x))),
                    ],
                    fields=list(pair),
                )
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * z.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), pa.array(model.centre.deviation(x), pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                    names=["vec_id", "deviation", "scores"],
                )

        scored = rows.mapInArrow(score, schema)
    return scored.select("vec_id", "deviation", F.posexplode("scores").alias("place", "s")).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.col("s.whitened").alias("whitened"), F.col("s.explained").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
