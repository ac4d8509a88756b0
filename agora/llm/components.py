"""Connected components of an edge table, by alternating star contractions.

Each round is two aggregations and two joins over the edges alone, kept in the
shared folder; a node with very many neighbours is pre-aggregated before the
shuffle and its join is split by adaptive execution.  Nothing is collected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import kept


class Forest:
    """Union by smallest member over positions 0..n-1, in whole arrays of links."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.roots()
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Hang neighbours on each node's smallest neighbour.

    ``both_ways`` hangs the larger neighbours of every node (large star), else
    a node and its smaller neighbours (small star).
    """
    if both_ways:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = near.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        hung = near.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        hung = hung.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return hung.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    The number of rounds grows with the logarithm of the number of nodes.  Edges
    may repeat and may join a node with itself; such a node alone is not returned.
    """
    edges = edges.select("a", "b").where("a <> b").distinct()
    last = kept(edges)
    seen = None
    while last.rows:
        large = kept(_star(last.frame, True))
        small = kept(_star(large.frame, False))
        mark = small.frame.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[0]
        last = small
        if mark == seen:
            break
        seen = mark
    return last.frame.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        last.frame.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
