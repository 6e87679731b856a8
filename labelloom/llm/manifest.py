"""Merkle manifest of a dataset: every row a leaf, one tree per group, one tree over the groups.

Leaves are appended in order to open subtrees of fan-out ``FAN``. A leaf starts
with an empty witness; whenever the run that holds it is complete (or the tree
ends), the run becomes one node and the witnesses of all leaves below it are
extended by the siblings left and right of their path. Spark deals the leaves
out in aligned blocks of ``BLOCK`` leaves, so a block's root does not depend on
any other block; block roots are then appended like leaves of a tree above, and
so on until one node is left. A witness of a row is the one inside its block
followed by the block's own, so no row carries more than it needs: the long
upper part is kept once per block and meets the block's rows in one task.

Positions come from a range-partitioned, written order (group, key, leaf), so a
group with a third of all rows is many slices and many blocks. One task never
holds more than a block and its witnesses.

Defined cases: a null group is a group of its own and comes first; null keys
come first in their group; rows with equal keys are ordered by their leaf, so
equal rows are interchangeable; a group with one row has that leaf as its root;
an empty table gives an empty result; other columns of the table play no part.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelloom.operators.ordering import sorted_slices
from labelloom.session import settle

FAN = 16
LEVELS = 3  # levels of a block
BLOCK = FAN**LEVELS

Step = tuple[str, str]  # the siblings to the left and to the right of a path, joined
STEPS = "array<struct<left: string, right: string>>"


def digest(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def height(leaves: int) -> int:
    """Levels above ``leaves`` nodes until one is left."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


class OpenTree:
    """Open subtrees of a tree that grows at its right end.

    ``runs[k]`` holds the nodes of level k whose run is not complete, each with
    the witnesses of the leaves below it.
    """

    def __init__(self, levels: int):
        self.runs: list[list[tuple[str, list[list[Step]]]]] = [[] for _ in range(levels + 1)]

    def append(self, leaf: str) -> list[Step]:
        """The leaf's witness: it goes on growing until ``root`` is called."""
        witness: list[Step] = []
        self._put(0, leaf, [witness])
        return witness

    def _put(self, level: int, node: str, below: list[list[Step]]) -> None:
        self.runs[level].append((node, below))
        if level < len(self.runs) - 1 and len(self.runs[level]) == FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run = self.runs[level]
        self.runs[level] = []
        nodes = [node for node, _ in run]
        for i, (_, below) in enumerate(run):
            step = ("".join(nodes[:i]), "".join(nodes[i + 1 :]))
            for witness in below:
                witness.append(step)
        self._put(level + 1, digest("".join(nodes)), [w for _, below in run for w in below])

    def root(self) -> str:
        """Complete the open runs from below; later leaves would start another tree."""
        for level in range(len(self.runs) - 1):
            if self.runs[level]:
                self._complete(level)
        return self.runs[-1][0][0]


def folded(leaf: str, witness: Sequence[Step]) -> str:
    """The root that ``leaf`` leads to along its witness."""
    for left, right in witness:
        leaf = digest(left + leaf + right)
    return leaf


def leaf_of(*values: Column) -> Column:
    """Digest of the values: ``-`` for null, else length in bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def placed(leaves: DataFrame) -> DataFrame:
    """Leaves (tree, key, leaf, changed) with ``place`` in their tree and the tree's ``total``.

    A tree spans at most as many slices as the order has, which bounds the
    window over (tree, slice) rows.
    """
    sliced = sorted_slices(leaves, ["tree", "key", "leaf"])
    spans = sliced.groupBy("tree", "__slice").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    tree = Window.partitionBy("tree")
    spans = spans.select(
        "tree", "__slice",
        (F.sum("__n").over(tree.orderBy("__slice")) - F.col("__n") - F.col("__first")).alias("__shift"),
        F.sum("__n").over(tree).alias("total"),
    )
    joined = sliced.join(spans, ["__slice", "tree"])
    return joined.select(*leaves.columns, (F.col("__shift") + F.col("__row")).alias("place"), "total")


def _block_levels(total: int) -> int:
    """A block that is its whole tree ends at its own root; others are as high as all blocks."""
    return height(total) if total <= BLOCK else LEVELS


def _block_root(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("place")
    total = int(part["total"].iloc[0])
    grown = OpenTree(_block_levels(total))
    for leaf in part["digest"]:
        grown.append(leaf)
    first = part.iloc[:1]
    return pd.DataFrame(
        {"tree": first["tree"], "place": first["block"], "total": -(-total // BLOCK), "digest": [grown.root()]}
    )


def _block_witnesses(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("place")
    grown = OpenTree(_block_levels(int(part["total"].iloc[0])))
    found = [grown.append(leaf) for leaf in part["digest"]]
    root = grown.root()
    return pd.DataFrame(
        {
            "tree": part["tree"], "place": part["place"], "total": part["total"], "digest": part["digest"],
            "block": part["block"], "block_root": root,
            "witness": [[{"left": a, "right": b} for a, b in w] for w in found],
        }
    )


NODES = "tree string, place long, total long, digest string"


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / BLOCK))


def climbed(nodes: DataFrame, most: int) -> DataFrame:
    """(tree, place, digest, witness, root) of nodes (tree, place, total, digest); ``most`` bounds ``total``."""
    inside = settle(
        _in_blocks(nodes)
        .groupBy("tree", "block")
        .applyInPandas(_block_witnesses, f"{NODES}, block long, block_root string, witness {STEPS}")
    )
    if most <= BLOCK:
        return inside.select("tree", "place", "digest", "witness", F.col("block_root").alias("root"))
    roots = inside.filter(F.col("place") % BLOCK == 0).select(
        "tree", F.col("block").alias("place"), F.ceil(F.col("total") / BLOCK).alias("total"),
        F.col("block_root").alias("digest"),
    )
    above = climbed(roots, -(-most // BLOCK)).select(
        "tree", F.col("place").alias("block"), F.col("witness").alias("upper"), "root"
    )
    return inside.join(above, ["tree", "block"]).select(
        "tree", "place", "digest", F.concat("witness", "upper").alias("witness"), "root"
    )


def _proofs(leaves: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    """Rows of one block; ``above`` is the one row with the witness of the block."""
    leaves = leaves.sort_values("place")
    top = above.iloc[0]
    upper = [(s["left"], s["right"]) for s in top["witness"]]
    upper_text = "".join(a + b for a, b in upper)
    grown = OpenTree(_block_levels(int(leaves["total"].iloc[0])))
    found = [grown.append(leaf) for leaf in leaves["digest"]]
    grown.root()
    starts = leaves["changed"].fillna(leaves["digest"])
    return pd.DataFrame(
        {
            "key": leaves["key"], "leaf": leaves["digest"], "subroot": top["subroot"], "root": top["root"],
            "proof": [digest("".join(a + b for a, b in w) + upper_text) for w in found],
            "folded": [folded(leaf, [*w, *upper]) for leaf, w in zip(starts, found, strict=True)],
        }
    )


def manifest(leaves: DataFrame) -> DataFrame:
    """(key, leaf, subroot, root, proof, folded) of every row of ``leaves`` (group, key, leaf, changed).

    ``changed`` is another leaf to fold along the row's witness, null for the
    leaf itself; ``folded`` equals ``root`` only if that leaf is the true one.
    """
    key_type = leaves.schema["key"].dataType.simpleString()
    tree = F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit(""))  # null first
    # range order of the key as it is, text of it from there on: pandas would turn longs with nulls into doubles
    written = settle(leaves.select(tree.alias("tree"), "key", "leaf", "changed"))
    rows = placed(written).withColumn("key", F.col("key").cast("string")).withColumnRenamed("leaf", "digest")
    rows = _in_blocks(settle(rows))
    most = rows.agg(F.max("total")).first()[0] or 0
    blocks = rows.select("tree", "place", "total", "digest", "block")
    roots = settle(blocks.groupBy("tree", "block").applyInPandas(_block_root, NODES))
    inner = settle(climbed(roots, math.ceil(most / BLOCK)))

    subroots = inner.filter("place = 0").select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("leaf"))
    groups = settle(placed(subroots.withColumn("changed", F.lit(None).cast("string"))))
    n_groups = groups.agg(F.max("total")).first()[0] or 0
    over = climbed(groups.select("tree", "place", "total", F.col("leaf").alias("digest")), n_groups)
    outer = groups.join(over.drop("tree", "digest"), "place").select(
        F.col("key").alias("tree"), F.col("witness").alias("outer"), F.col("root").alias("top")
    )
    above = inner.join(outer, "tree").select(
        "tree", F.col("place").alias("block"), F.concat("witness", "outer").alias("witness"),
        F.col("root").alias("subroot"), F.col("top").alias("root"),
    )
    found = (
        rows.groupBy("tree", "block")
        .cogroup(above.groupBy("tree", "block"))
        .applyInPandas(_proofs, "key string, leaf string, subroot string, root string, proof string, folded string")
    )
    return found.withColumn("key", F.col("key").cast(key_type))
