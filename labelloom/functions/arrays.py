"""Array expressions that stay inside the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A lambda that mentions an outer expression evaluates it for every element;
    binding it as the element of a one-item array keeps the cost linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal(value, ddl: str) -> Column:
    """Nested numbers or records as one constant (folded before execution)."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def double_array(values: Sequence[float] | np.ndarray) -> Column:
    return literal([float(v) for v in values], "array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def scale(x: Column, center: Sequence[float], spread: Sequence[float]) -> Column:
    """(x - center) / spread per position."""
    centred = F.zip_with(x, double_array(center), lambda v, m: v - m)
    return F.zip_with(centred, double_array(spread), lambda v, s: v / s)


def project(x: Column, axes: np.ndarray) -> Column:
    """Scores of ``x`` on each row of ``axes`` (k x d) as array<double>."""
    weights = literal([[float(v) for v in row] for row in axes], "array<array<double>>")
    return let(x, lambda v: F.transform(weights, lambda w: dot(v, w)))
