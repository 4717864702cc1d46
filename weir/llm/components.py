"""Connected components of an edge table, by rounds of contraction in DataFrames.

In a round each node points to the smallest of its neighbours and itself, pointers are doubled until they end in
roots, and edges are redrawn between roots. Nodes with an edge at least halve in each round, so rounds are as many as
the logarithm of the largest component at most; chains are doubled, so long ones take few joins. All state is written
tables; the driver sees only whether rows are left. After 64 rounds, which no table can need, it fails.

Defined cases: edges of a node to itself don't count; repeated edges are one; an empty table has no nodes; a null end
is no node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _pointed(pointers: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """From (node, root) with root <= node, the same with each root followed to its end."""
    for k in range(64):
        onward = pointers.select(F.col("node").alias("root"), F.col("root").alias("next")).where("root <> next")
        if onward.isEmpty():
            break
        pointers = scratch.save(
            pointers.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            f"{label}-{k}",
        )
        if pointers.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("pointers are longer than 64 doublings follow")
    return pointers.select("node", "root")


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """edges: (a, b). Returns (node, root) for each node that has an edge to another, root being one node of its
    component, the same for all of them (roots themselves included)."""
    edges = edges.where("a <> b")  # nulls go too
    levels: list[DataFrame] = []
    for k in range(64):
        if edges.isEmpty():
            break
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root"))
        roots = _pointed(scratch.save(least, f"{label}-{k}-least"), scratch, f"{label}-{k}-pointed")
        levels.append(roots)
        to_a, to_b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab")
        edges = scratch.save(
            edges.join(to_a, "a").join(to_b, "b").where("a_root <> b_root").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(),
            f"{label}-{k}-edges",
        )
    else:
        raise RuntimeError("edges are left after 64 contractions")
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def onward(done: DataFrame, level: DataFrame) -> DataFrame:
        level = level.select(F.col("node").alias("root"), F.col("root").alias("next"))
        return done.join(level, "root", "left").select("node", F.coalesce("next", "root").alias("root"))

    return scratch.save(reduce(onward, levels), f"{label}-roots")
