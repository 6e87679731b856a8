"""Which column plays which part; operators address columns by role, not position."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIDDEN = "hidden_class"  # fixed value: name of the class of rows without labels


@dataclass(frozen=True)
class Roles:
    key: str
    categoricals: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()  # packed array<double> columns
    prefixes: dict[str, str] = field(default_factory=dict)  # group -> wide column prefix


def named(name: str) -> Column:
    """Column by its literal name, also when it holds dashes or dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def pack(df: DataFrame, roles: Roles) -> DataFrame:
    """Wide feature columns -> one array column per group (narrow rows, small plans)."""
    arrays = []
    used: set[str] = set()
    for group in roles.groups:
        cols = [c for c in df.columns if c.startswith(roles.prefixes[group])]
        used.update(cols)
        arrays.append(F.array(*[named(c).cast("double") for c in cols]).alias(group))
    rest = [named(c) for c in df.columns if c not in used]
    return df.select(*rest, *arrays)


def unpack(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Inverse of :func:`pack` for groups of known width; columns ``<group>-<i>``."""
    rest = [named(c) for c in df.columns if c not in widths]
    wide = [
        F.get(named(g), F.lit(i)).alias(f"{g}-{i}") for g, n in widths.items() for i in range(n)
    ]
    return df.select(*rest, *wide)
