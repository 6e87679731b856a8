"""Connected components of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.session import settle


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo") % 1_000_003)).first())


def _pairs(df: DataFrame, x, y) -> DataFrame:
    return (
        df.select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).filter("hi <> lo").distinct()
    )


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) of every linked node but the smallest of its component: label is that smallest id.

    A star round hangs all larger neighbours of a node, then all smaller ones,
    on its smallest neighbour; the number of rounds grows with the logarithm of
    the component size. Minima are pre-aggregated, so a node with very many
    links is never gathered in one task. Each round is written to the shared folder.
    """
    edges = settle(_pairs(links, F.col(a), F.col(b)))
    state = _state(edges)
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _pairs(both.filter("v > u").join(low, "u"), F.col("v"), F.col("m"))
        large = settle(large)
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi")
        edges = settle(
            _pairs(
                small.select(F.col("lo").alias("x"), "m").unionByName(low.select(F.col("hi").alias("x"), "m")),
                F.col("x"),
                F.col("m"),
            )
        )
        if (now := _state(edges)) == state:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
        state = now
