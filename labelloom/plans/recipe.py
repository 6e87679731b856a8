"""Ordered feature steps, fitted on training rows and applied to any rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.arrays import scale
from labelloom.functions.rowstats import STATS, row_stats
from labelloom.operators.columns import combine_categories
from labelloom.operators.encoders import category_levels, integer_encode, level_codes, level_counts
from labelloom.operators.joins import frozen_if_small
from labelloom.operators.moments import Moments, fold_moments_of, train_moments
from labelloom.operators.pca import PcaFit, fit_pca, fit_pca_folds, pca_scores
from labelloom.roles import named
from labelloom.session import settle

Apply = Callable[[DataFrame], DataFrame]


def sized(table: DataFrame) -> DataFrame:
    """A lookup table computed once: marked for broadcast only if it is small."""
    small = frozen_if_small(table)
    return settle(table) if small is None else F.broadcast(small)


@dataclass(frozen=True)
class RowStats:
    """Per-row statistics of the groups, packed as one array column ``stats``."""

    groups: Sequence[str]
    stats: Sequence[str] = tuple(STATS)
    per_fold = False

    @property
    def reads(self) -> set[str]:
        return set(self.groups)

    @property
    def writes(self) -> set[str]:
        return {"stats"}

    def fit(self, df: DataFrame) -> Apply:
        names = [f"{g}_{s}" for g in self.groups for s in self.stats]

        def apply(d: DataFrame) -> DataFrame:
            wide = row_stats(d, self.groups, self.stats)
            packed = F.array(*[named(n) for n in names]).alias("stats")
            return wide.select(*[named(c) for c in d.columns], packed)

        return apply


@dataclass(frozen=True)
class Combine:
    """One categorical made of several."""

    columns: Sequence[str]
    name: str = "combined"
    per_fold = False

    @property
    def reads(self) -> set[str]:
        return set(self.columns)

    @property
    def writes(self) -> set[str]:
        return {self.name}

    def fit(self, df: DataFrame) -> Apply:
        return lambda d: d.withColumn(self.name, combine_categories(self.columns))


@dataclass(frozen=True)
class OneHot:
    """Indicators of all levels as one array column; unseen levels fail."""

    columns: Sequence[str]
    name: str = "onehot"
    per_fold = False

    @property
    def reads(self) -> set[str]:
        return set(self.columns)

    @property
    def writes(self) -> set[str]:
        return {self.name}

    def fit(self, df: DataFrame) -> Apply:
        levels = category_levels(df, self.columns)
        flags = []
        for c, found in levels.items():
            text = named(c).cast("string")
            for i, v in enumerate(found):
                flag = F.when(text == F.lit(v), 1.0).otherwise(0.0)
                if i == 0:
                    unknown = F.raise_error(F.lit(f"unknown level of {c}")).cast("double")
                    flag = F.when(text.isin(*found), flag).otherwise(unknown)
                flags.append(flag)
        return lambda d: d.withColumn(self.name, F.array(*flags))


@dataclass(frozen=True)
class IntegerCode:
    """Zero-based code per level as ``<col>_code``, null for unseen levels."""

    columns: Sequence[str]
    per_fold = False

    @property
    def reads(self) -> set[str]:
        return set(self.columns)

    @property
    def writes(self) -> set[str]:
        return {f"{c}_code" for c in self.columns}

    def fit(self, df: DataFrame) -> Apply:
        codes = {c: level_codes(df, c) for c in self.columns}

        def apply(d: DataFrame) -> DataFrame:
            for c, table in codes.items():
                d = integer_encode(d, table, c, f"{c}_code")
            return d

        return apply


@dataclass(frozen=True)
class CountEncode:
    """Training frequency of each level as ``<col>_counts``, 0 where unseen."""

    columns: Sequence[str]
    per_fold = True

    @property
    def reads(self) -> set[str]:
        return set(self.columns)

    @property
    def writes(self) -> set[str]:
        return {f"{c}_counts" for c in self.columns}

    def _apply(self, tables: dict[str, DataFrame]) -> Apply:
        def apply(d: DataFrame) -> DataFrame:
            for c, t in tables.items():
                d = d.join(t, c, "left")
            return d.fillna(0, [f"{c}_counts" for c in tables])

        return apply

    def fit(self, df: DataFrame) -> Apply:
        return self._apply({c: sized(t) for c, t in level_counts(df, self.columns).items()})

    def fit_folds(self, df: DataFrame, folds: Sequence[int]) -> dict[int, Apply]:
        """One count per level with a column per fold: the rows outside that fold."""
        out: dict[int, dict[str, DataFrame]] = {f: {} for f in folds}
        for c in self.columns:
            outside = [F.sum((F.col("kfold") != f).cast("bigint")).alias(f"__{f}") for f in folds]
            counts = df.groupBy(c).agg(*outside)
            small = frozen_if_small(counts)
            base = settle(counts) if small is None else small
            for f in folds:
                t = base.select(c, F.col(f"__{f}").alias(f"{c}_counts"))
                out[f][c] = t if small is None else F.broadcast(t)
        return {f: self._apply(t) for f, t in out.items()}


@dataclass(frozen=True)
class Pca:
    """Scores per group, as array column ``<prefix><group>``."""

    groups: Sequence[str]
    k: int | None = 2
    threshold: float | None = None
    center: bool = True
    scaled: bool = True
    prefix: str = "pc"
    replace: bool = False
    per_fold = True

    @property
    def reads(self) -> set[str]:
        return set(self.groups)

    @property
    def writes(self) -> set[str]:
        return {f"{self.prefix}{g}" for g in self.groups}

    def _apply(self, fits: dict[str, PcaFit]) -> Apply:
        def apply(d: DataFrame) -> DataFrame:
            for g, fit in fits.items():
                before = d.columns
                d = pca_scores(d, g, fit, "__s")
                scores = [named(f"__s{i + 1}") for i in range(len(fit.axes))]
                kept = [named(c) for c in before if not (self.replace and c == g)]
                d = d.select(*kept, F.array(*scores).alias(f"{self.prefix}{g}"))
            return d

        return apply

    def fit(self, df: DataFrame) -> Apply:
        return self._apply(
            {
                g: fit_pca(df, g, self.k, self.threshold, self.center, self.scaled)
                for g in self.groups
            }
        )

    def fit_folds(self, df: DataFrame, folds: Sequence[int]) -> dict[int, Apply]:
        by_group = {
            g: fit_pca_folds(
                df, g, self.k, scaled=self.scaled, threshold=self.threshold, center=self.center
            )
            for g in self.groups
        }
        return {f: self._apply({g: by_group[g][f] for g in self.groups}) for f in folds}


@dataclass(frozen=True)
class Scale:
    """Packed groups and scalar columns to mean 0 and sd 1; scalars are packed
    into the array column ``scalars``."""

    groups: Sequence[str] = ()
    scalars: Sequence[str] = ()
    ddof: int = 0
    per_fold = True

    @property
    def reads(self) -> set[str]:
        return {*self.groups, *self.scalars}

    @property
    def writes(self) -> set[str]:
        return set(self._names())

    def clean_part(self, dirty: set[str]) -> Scale | None:
        """The columns no earlier step made fold-dependent."""
        groups = [g for g in self.groups if g not in dirty]
        scalars = () if dirty & set(self.scalars) else self.scalars
        return Scale(groups, scalars, self.ddof) if groups or scalars else None

    def dirty_part(self, dirty: set[str]) -> Scale | None:
        groups = [g for g in self.groups if g in dirty]
        scalars = self.scalars if dirty & set(self.scalars) else ()
        return Scale(groups, scalars, self.ddof) if groups or scalars else None

    def _packed(self, d: DataFrame) -> DataFrame:
        if not self.scalars:
            return d
        array = F.array(*[named(c).cast("double") for c in self.scalars])
        return d.withColumn("scalars", array).drop(*self.scalars)

    def _names(self) -> list[str]:
        return [*self.groups, *(["scalars"] if self.scalars else [])]

    def _apply(self, fits: dict[str, Moments]) -> Apply:
        return Scaled(self, {g: (m.mean, m.spread(self.ddof)) for g, m in fits.items()})

    def fit(self, df: DataFrame) -> Apply:
        packed = self._packed(df)
        return self._apply({g: m[0] for g, m in fold_moments_of(packed, self._names()).items()})

    def fit_folds(self, df: DataFrame, folds: Sequence[int]) -> dict[int, Apply]:
        packed = self._packed(df)
        per = fold_moments_of(packed, self._names(), "kfold")
        return {
            f: self._apply({g: train_moments(m, f) for g, m in per.items()}) for f in folds
        }


@dataclass(frozen=True)
class Scaled:
    """A fitted :class:`Scale`: mean and spread per column."""

    step: Scale
    fits: Mapping[str, tuple[np.ndarray, np.ndarray]]

    def __call__(self, d: DataFrame) -> DataFrame:
        return self.step._packed(d).withColumns({g: scale(named(g), *fit) for g, fit in self.fits.items()})


@dataclass(frozen=True)
class FittedRecipe:
    applies: list[Apply] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        for apply in self.applies:
            df = apply(df)
        return df


@dataclass(frozen=True)
class Recipe:
    """Steps in order; ``features`` names the array columns that form the matrix."""

    steps: Sequence
    features: Sequence[str]

    def fit(self, train: DataFrame) -> FittedRecipe:
        applies, current = [], train
        for step in self.steps:
            apply = step.fit(current)
            applies.append(apply)
            current = apply(current)
        return FittedRecipe(applies)

    def leading(self) -> tuple[Recipe, Recipe]:
        """The steps that fit the same on every fold, and the rest."""
        n = next((i for i, s in enumerate(self.steps) if s.per_fold), len(self.steps))
        return Recipe(self.steps[:n], self.features), Recipe(self.steps[n:], self.features)

    def fit_folds(self, df: DataFrame, folds: Sequence[int]) -> dict[int, FittedRecipe]:
        """One fitted recipe per fold.

        Columns that are the same for all folds are fitted from one pass over
        all rows (statistics of the other folds are total minus own fold);
        only columns an earlier step made fold-dependent need a pass per fold.
        """
        applies: dict[int, list[Apply]] = {f: [] for f in folds}
        shared, dirty = df, set()
        current = {f: df for f in folds}

        def add(fits: dict[int, Apply]) -> None:
            for f in folds:
                applies[f].append(fits[f])
                current[f] = fits[f](current[f])

        for step in self.steps:
            if not step.per_fold and not step.reads & dirty:
                apply = step.fit(shared)
                shared = apply(shared)
                add({f: apply for f in folds})
                continue
            parts = [step]
            if isinstance(step, Scale):
                parts = [p for p in (step.clean_part(dirty), step.dirty_part(dirty)) if p]
            for part in parts:
                if part.reads & dirty or not hasattr(part, "fit_folds"):
                    add({f: part.fit(current[f].filter(F.col("kfold") != f)) for f in folds})
                else:
                    add(part.fit_folds(shared, folds))
            dirty |= step.writes
        return {f: FittedRecipe(a) for f, a in applies.items()}

    def views(self, df: DataFrame, fitted: Mapping[int, FittedRecipe]) -> dict[int, np.ndarray] | None:
        """Per fold the matrix that turns (x, 1) of the first fold's features into that fold's, or None where more
        than one scaling per column is between them."""
        first, *_ = folds = list(fitted)
        fits: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
        for applies in zip(*(fitted[f].applies for f in folds), strict=True):
            if all(a is applies[0] for a in applies) and not fits:
                continue
            if not all(isinstance(a, Scaled) for a in applies) or set(fits) & set(applies[0].fits):
                return None
            for name in applies[0].fits:
                fits[name] = {f: a.fits[name] for f, a in zip(folds, applies, strict=True)}
        sizes = fitted[first].transform(df).select(*[F.size(named(c)) for c in self.features]).first()
        if sizes is None or None in sizes or -1 in sizes:
            return None
        out = {}
        for f in folds:
            ratio, shift = [], []
            for c, size in zip(self.features, sizes, strict=True):
                (m0, s0), (m, s) = (fits[c][first], fits[c][f]) if c in fits else [(np.zeros(size), np.ones(size))] * 2
                ratio.append(s0 / s), shift.append((m0 - m) / s)
            out[f] = np.diag([*np.concatenate(ratio), 1.0])
            out[f][-1, :-1] = np.concatenate(shift)
        return out

    def matrix(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` plus one array column ``x``."""
        x = F.concat(*[named(c) for c in self.features])
        return df.select(*[named(c) for c in keep], x.alias("x"))


def column_count(df: DataFrame, arrays: Sequence[str]) -> int:
    """Width of the matrix, from the first row."""
    row = df.select(*[F.size(named(a)).alias(a) for a in arrays]).first()
    return sum(row[a] for a in arrays)
