"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One star step over (u, v) with u > v: each node's far side is tied to the least of its neighbours and itself."""
    if small:
        near = links
    else:
        near = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    if small:
        tied = joined.select(F.col("v").alias("x"), "m").unionAll(joined.select(F.col("u").alias("x"), "m"))
    else:
        tied = joined.where("v > u").select(F.col("v").alias("x"), "m")
    return tied.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()


def connected_components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) for every node of links (a, b), a component being named by its least node.

    Each round is a large-star and a small-star step over the links that are left, checkpointed; the number of links never
    grows, and rounds are logarithmic in the longest path in practice. Links of a node to itself and nulls count for nothing.
    """
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        large = _star(now, small=False)
        after = cut(_star(large, small=True))
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        now, seen = after, mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of each a and b; ``label`` names each row's set by its least row."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not (label == label[label]).all():
            label[:] = label[label]
