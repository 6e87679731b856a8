"""Logistic regression and naive Bayes for all classes, strengths and folds in one set of passes.

Rows are packed once into blocks of numbers, one block table for all folds
(``part``). A pass over the blocks takes the coefficients of every model still
at work, one matrix per part, and returns loss and gradient of all of them: the
number of jobs is that of the slowest model and does not grow with classes,
strengths or folds. Where the features of two folds differ by an affine map
only, the rows are packed once for all folds (``views``) and their products are
formed once for all models. Only coefficients, gradients and cross products of
the features meet the driver, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.models.bayes import SMOOTHING
from labelloom.roles import named

BLOCK_ROWS = 8192
PIECE = 512  # rows whose products are formed at a time
NARROW = 64  # columns up to which the products of all pairs of columns are formed once for all models
FAN = 64  # partial sums the driver adds up at once
MEMORY = 12  # steps the quasi-Newton method remembers
CURVATURE_NUMBERS = 2_000_000  # second derivatives of a part that one pass may return
FLAT = 1e-12  # relative difference of two objectives that rounding of their sums may hide
BLOCKS = "part int, n long, x binary, y binary"


def numbers(column: pa.Array) -> np.ndarray:
    """Matrix of a list column."""
    if column.null_count:
        raise ValueError("a row has no features")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a feature is null")
    out = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    if not np.isfinite(out).all():
        raise ValueError("a feature is not finite")
    return out


def packed(rows: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Blocks of ``rows`` (part, x, one 0/1 column per class)."""
    given = rows.select(
        F.col("part").cast("int").alias("part"), "x",
        F.array(*[named(c).cast("double") for c in classes]).alias("y"),
    )

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").to_numpy()
            x, y = numbers(batch.column("x")), numbers(batch.column("y")).astype(np.uint8)
            for p in np.unique(part):
                of = part == p
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([p], pa.int32()), "n": pa.array([int(of.sum())], pa.int64()),
                        "x": [x[of].tobytes()], "y": [y[of].tobytes()],
                    }
                )

    return given.mapInArrow(pack, BLOCKS)


def summed(blocks: DataFrame, measure: Callable[[int, np.ndarray, np.ndarray], Mapping], classes: int, tasks: int) -> dict:
    """Sums over all blocks of ``measure(part, x, y)``, which gives a value per part that the block counts for.

    A task adds up its own blocks; beyond ``FAN`` tasks groups of them are added up before the driver does.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "x", "y"))):
                found = measure(p, np.frombuffer(x).reshape(n, -1), np.frombuffer(y, np.uint8).reshape(n, classes))
                for of, value in found.items():
                    sums[of] = sums[of] + value if of in sums else value
        if sums:
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(list(sums), pa.int32()),
                    "task": pa.array([TaskContext.get().partitionId()] * len(sums), pa.int32()),
                    "value": [v.tobytes() for v in sums.values()],
                }
            )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("task")
        total = sum(np.frombuffer(v) for v in rows["value"])
        return pd.DataFrame({"part": rows["part"].iloc[:1], "task": rows["task"].iloc[:1] // FAN, "value": [total.tobytes()]})

    schema = "part int, task int, value binary"
    found = blocks.mapInArrow(run, schema)
    while tasks > FAN:
        found = found.groupBy("part", F.floor(F.col("task") / FAN)).applyInPandas(add, schema)
        tasks = -(-tasks // FAN)
    out: dict[int, np.ndarray] = {}
    for row in sorted(found.collect(), key=lambda r: (r["part"], r["task"])):
        value = np.frombuffer(row["value"])
        out[row["part"]] = out[row["part"]] + value if row["part"] in out else value
    return out


def loss_and_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, curved: bool) -> np.ndarray:
    """Rows: summed loss, its gradient and, if ``curved``, its second derivatives, of every column of ``w`` (last
    row: intercepts)."""
    d = len(w)
    out = np.zeros((1 + d + (d * d if curved else 0), w.shape[1]))
    upper = np.triu_indices(d)
    pairs = np.zeros((len(upper[0]), w.shape[1])) if curved and d <= NARROW else None
    for at in range(0, len(x), PIECE):
        part, truth = x[at : at + PIECE], y[at : at + PIECE]
        one = np.vstack([part.T, np.ones(len(part))])
        z = one.T @ w
        e = np.exp(-np.abs(z))
        p = 1.0 / (1.0 + e)
        p = np.where(z >= 0, p, e * p)
        out[0] += (np.log1p(e) + np.maximum(z, 0.0) - truth * z).sum(axis=0)
        out[1 : d + 1] += one @ (p - truth)
        if not curved:
            continue
        v = p * (1.0 - p)
        if pairs is not None:  # every product of two columns, as the upper triangle has them
            pairs += np.vstack([one[i] * one[i:] for i in range(d)]) @ v
        else:
            out[d + 1 :] += np.column_stack([((one * v[:, j]) @ one.T).ravel() for j in range(w.shape[1])])
    if pairs is not None:
        full = np.zeros((d, d, w.shape[1]))
        full[upper] = pairs
        full[upper[::-1]] = pairs
        out[d + 1 :] = full.reshape(d * d, -1)
    return out


def inverse(bound: np.ndarray) -> np.ndarray:
    return np.linalg.inv(bound + np.eye(len(bound)) * (1e-14 * np.trace(bound) / len(bound)))


class Descent:
    """One model's way down on the mean objective; ``trial`` is what the next pass evaluates.

    With second derivatives the steps are Newton's. Without, they are
    limited-memory quasi-Newton steps whose metric is the inverse of a fixed
    bound of the curvature (a quarter of the features' cross products plus the
    penalty), so a plain step in it always descends. Steps that do not lower
    the objective enough are halved. Where two values differ by less than the
    rounding of their sums, the slope at the trial decides instead: it is exact
    to many more digits, and a value's noise would halve steps without end.
    """

    def __init__(self, start: np.ndarray, metric: np.ndarray, ridge: np.ndarray, tol: float):
        self.metric, self.ridge, self.tol = metric, ridge, tol
        self.trial, self.at, self.value, self.done = start, None, np.inf, False
        self.gradient = self.direction = None
        self.slope, self.step = 0.0, 1.0
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def told(self, loss: float, gradient: np.ndarray, curvature: np.ndarray | None = None) -> None:
        """Mean loss and its derivatives at ``trial``."""
        value = loss + 0.5 * float(self.ridge @ self.trial**2)
        gradient = gradient + self.ridge * self.trial
        if self.at is not None:
            if abs(value - self.value) <= FLAT * abs(self.value):
                short = gradient @ self.direction > (2e-4 - 1) * self.slope
            else:
                short = value > self.value + 1e-4 * self.step * self.slope
            if short:
                if self.step < 0.1 and self.pairs:
                    self.pairs.clear()  # the plain step, which descends
                    self._aim(1.0)
                elif self.step < 1e-9:
                    self.done = True  # no step changes the value: rounding is reached
                else:
                    self.step *= 0.5
                    self.trial = self.at + self.step * self.direction
                return
            s, y = self.trial - self.at, gradient - self.gradient
            if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
                self.pairs = [*self.pairs[1 - MEMORY :], (s, y)]
        self.at, self.value, self.gradient = self.trial, value, gradient
        if curvature is not None:
            self.metric, self.pairs = inverse(curvature + np.diag(self.ridge)), []
        if np.sqrt(gradient @ self.metric @ gradient) <= self.tol:
            self.done = True
        else:
            self._aim(1.0)

    def _aim(self, step: float) -> None:
        q, kept = self.gradient.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        q = self.metric @ q
        for (s, y), a in zip(self.pairs, reversed(kept)):
            q += s * (a - (y @ q) / (s @ y))
        self.direction, self.step = -q, step
        self.slope = float(self.gradient @ self.direction)
        self.trial = self.at + step * self.direction


@dataclass(frozen=True)
class Linear:
    """Coefficients per part: (features + 1) x (classes * strengths), strengths of a class side by side.

    A class without positives in a part has probability 0 there, one without negatives 1.
    """

    weights: Mapping[int, np.ndarray]

    def proba(self, part: int, x: np.ndarray) -> np.ndarray:
        w = self.weights[part]
        z = x @ w[:-1] + w[-1]
        e = np.exp(-np.abs(z))
        return np.where(z >= 0, 1.0, e) / (1.0 + e)


def fit_logistic(
    blocks: DataFrame, classes: int, strengths: Sequence[float] | np.ndarray, tol: float = 1e-8, passes: int = 2000,
    views: Mapping[int, np.ndarray] | None = None,
) -> Linear:
    """Minimises C * sum(loss) + |w|^2 / 2 for every part, class and strength C; intercepts are free.

    ``strengths`` holds the values of C for all classes, or a row of them per
    class. ``tol`` bounds the gradient in the metric of the curvature bound. A
    model that is not there after ``passes`` raises, so none is returned unfinished.

    With ``views`` the part of a block is the fold of its rows: the models of
    fold f see the blocks of all others, with (x, 1) @ views[f] as features.
    """
    c = np.asarray(strengths, dtype=float)
    c = np.tile(c, (classes, 1)) if c.ndim == 1 else c
    tasks = blocks.rdd.getNumPartitions()

    def seen(part: int, among: Iterable[int]) -> list[int]:
        return [p for p in among if (p == part if views is None else p != part)]

    def moments(part: int, x: np.ndarray, y: np.ndarray) -> Mapping[int, np.ndarray]:
        one = np.hstack([x, np.ones((len(x), 1))])
        found = np.concatenate([(one.T @ one).ravel(), y.sum(axis=0, dtype=float)])
        return dict.fromkeys(seen(part, [part] if views is None else views), found)

    sums = summed(blocks, moments, classes, tasks)
    models: dict[tuple[int, int], Descent] = {}
    weights, sizes = {}, {}
    for part, found in sums.items():
        width = int(round(np.sqrt(len(found) - classes)))
        cross, ones = found[: width * width].reshape(width, width), found[width * width :]
        n = sizes[part] = cross[-1, -1]
        if views is not None:
            cross = views[part].T @ cross @ views[part]
        weights[part] = np.zeros((width, c.size))
        metrics: dict[float, np.ndarray] = {}
        for k in range(c.size):
            share, strength = ones[k // c.shape[1]] / n, c.ravel()[k]
            start = np.zeros(width)
            if share in (0.0, 1.0):
                weights[part][-1, k] = np.inf if share else -np.inf
                continue
            ridge = np.full(width, 1.0 / (strength * n))
            ridge[-1] = 0.0
            if strength not in metrics:
                metrics[strength] = inverse(cross / (4 * n) + np.diag(ridge))
            start[-1] = np.log(share / (1.0 - share))
            models[part, k] = Descent(start, metrics[strength], ridge, tol)
    todo = sorted(models)
    for _ in range(passes):
        if not todo:
            break
        trial = {p: np.column_stack([models[m].trial for m in todo if m[0] == p]) for p in {p for p, _ in todo}}
        which = {p: np.array([k // c.shape[1] for q, k in todo if q == p]) for p in trial}
        curved = {p: len(w) * w.size <= CURVATURE_NUMBERS for p, w in trial.items()}
        if views is not None:
            curved = dict.fromkeys(trial, all(curved.values()))
        at = {p: w if views is None else views[p] @ w for p, w in trial.items()}  # on the features of the blocks

        def measure(part: int, x: np.ndarray, y: np.ndarray, at=at, which=which, curved=curved) -> Mapping[int, np.ndarray]:
            of = seen(part, at)
            if not of:
                return {}
            w, truth = np.hstack([at[p] for p in of]), y[:, np.concatenate([which[p] for p in of])]
            found = loss_and_gradient(x, truth, w, curved[of[0]])
            cuts = np.cumsum([at[p].shape[1] for p in of])[:-1]
            return {p: v.ravel() for p, v in zip(of, np.split(found, cuts, axis=1), strict=True)}

        found = summed(blocks, measure, classes, tasks)
        for p, w in trial.items():
            told = found[p].reshape(-1, w.shape[1]) / sizes[p]
            d = len(w)
            view = np.eye(d) if views is None else views[p]
            for j, m in enumerate([m for m in todo if m[0] == p]):
                curvature = view.T @ told[d + 1 :, j].reshape(d, d) @ view if curved[p] else None
                models[m].told(told[0, j], view.T @ told[1 : d + 1, j], curvature)
        todo = [m for m in todo if not models[m].done]
    if todo:
        raise RuntimeError(f"{len(todo)} of {len(models)} models have not converged in {passes} passes")
    for (part, k), model in models.items():
        weights[part][:, k] = model.at
    return Linear(weights)


@dataclass(frozen=True)
class Bayes:
    """One-vs-rest Gaussian naive Bayes: per part the log prior odds and both sides' moments of every class."""

    tables: Mapping[int, tuple[np.ndarray, ...]]

    def proba(self, part: int, x: np.ndarray) -> np.ndarray:
        const, linear, square, centre, sure = self.tables[part]
        z = x - centre
        odds = const + z @ linear + (z * z) @ square
        e = np.exp(-np.abs(odds))
        p = np.where(odds >= 0, 1.0, e) / (1.0 + e)
        return np.where(np.isnan(sure), p, sure)


def fit_bayes_ovr(blocks: DataFrame, classes: int) -> Bayes:
    """Means and variances of every class and its rest, for all parts, in two passes.

    The second pass is centred at the part's mean, so large offsets of a feature do not cancel.
    """
    tasks = blocks.rdd.getNumPartitions()
    first = summed(blocks, lambda p, x, y: {p: np.concatenate([x.sum(axis=0), [len(x)]])}, classes, tasks)
    centre = {p: s[:-1] / s[-1] for p, s in first.items()}

    def moments(part: int, x: np.ndarray, y: np.ndarray) -> Mapping[int, np.ndarray]:
        z = x - centre[part]
        sides = np.hstack([y, np.ones((len(y), 1), np.uint8)]).astype(float)  # the last column: all rows
        return {part: np.vstack([sides.sum(axis=0), z.T @ sides, (z * z).T @ sides]).ravel()}

    tables = {}
    for part, found in summed(blocks, moments, classes, tasks).items():
        n, (s1, s2) = found[: classes + 1], found[classes + 1 :].reshape(2, -1, classes + 1)
        extra = SMOOTHING * (s2[:, -1] / n[-1] - (s1[:, -1] / n[-1]) ** 2).max()
        total = n[-1]
        sure = np.where(n[:-1] == 0, 0.0, np.where(n[:-1] == total, 1.0, np.nan))
        with np.errstate(divide="ignore", invalid="ignore"):
            sides = []
            for count, a, b in ((n[:-1], s1[:, :-1], s2[:, :-1]), (total - n[:-1], s1[:, -1:] - s1[:, :-1], s2[:, -1:] - s2[:, :-1])):
                mean = a / count
                var = np.maximum(b / count - mean**2, 0.0) + extra
                sides.append((np.log(count / total) - 0.5 * np.log(2 * np.pi * var).sum(axis=0), mean, var))
            (c1, m1, v1), (c0, m0, v0) = sides
            const = c1 - c0 - 0.5 * (m1**2 / v1 - m0**2 / v0).sum(axis=0)
            linear, square = m1 / v1 - m0 / v0, -0.5 * (1 / v1 - 1 / v0)
        known = np.isnan(sure)
        tables[part] = (*(np.where(known, v, 0.0) for v in (const, linear, square)), centre[part], sure)
    return Bayes(tables)


def scored(rows: DataFrame, model: Linear | Bayes, name: str = "p") -> DataFrame:
    """``rows`` (part, x, ...) without x and with the probabilities of all models as one array: one matrix product."""
    kept = [f for f in rows.schema.fields if f.name not in ("x", name)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part, x = batch.column("part").to_numpy(), numbers(batch.column("x"))
            out = None
            for p in np.unique(part):
                found = model.proba(int(p), x[part == p])
                out = np.empty((len(x), found.shape[1])) if out is None else out
                out[part == p] = found
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * out.shape[1])
            columns = {f.name: batch.column(f.name) for f in kept}
            yield pa.RecordBatch.from_pydict({**columns, name: pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))})

    return rows.mapInArrow(run, f"{schema}, `{name}` array<double>")
