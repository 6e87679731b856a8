"""Words and shared helpers of the text operators (built-in functions only)."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE_CHARS = " \t\n\x0b\x0c\r"  # what separates words; a word is a run of anything else


def whole(text: Column | str) -> Column:
    """The text, an empty one for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    for c in SPACE_CHARS[1:]:  # a plain one-character split is much cheaper than a pattern
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda x: F.xxhash64(x))


def joined_hashes(left: Column, right: Column, shift: int) -> Column:
    """Hash of ``left[i]`` and ``right[i + shift]`` for every i that has both."""
    size = F.greatest(F.size(right) - shift, F.lit(0))
    return F.zip_with(
        F.slice(left, F.lit(1), size), F.slice(right, F.lit(1 + shift), size), lambda a, b: F.xxhash64(a, b)
    )


def lower_ascii(text: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def index_range(size: Column) -> Column:
    """0 .. size - 1, empty for sizes below 1 (``sequence`` would count down)."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


def packed(df: DataFrame, text: str) -> DataFrame:
    """(row, text): the input row as one struct, so that no working column can clash with one of its columns."""
    return df.select(F.struct("*").alias("row"), whole(text).alias("text"))


def numbered(items: Iterable[str]) -> tuple[np.ndarray, list[str]]:
    """A number per item, and the distinct items in that order. (pandas' factorize ends strings at a NUL.)"""
    seen: dict[str, int] = {}
    codes = np.fromiter((seen.setdefault(x, len(seen)) for x in items), dtype=np.int64)
    return codes, list(seen)
