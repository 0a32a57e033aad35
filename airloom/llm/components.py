"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.llm.common import stored


def local_roots(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member index of each member's component, for the links of one tile."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[left], root[right])
        grown = root.copy()
        np.minimum.at(grown, left, low)
        np.minimum.at(grown, right, low)
        np.minimum.at(grown, root[left], low)
        np.minimum.at(grown, root[right], low)
        grown = grown[grown]
        if np.array_equal(grown, root):
            return root
        root = grown


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star operation: the neighbours of a node are tied to the smallest of them and itself instead.

    The smallest neighbour is found with a partial sum per task and joined back, so a node with very many
    neighbours is a skewed join, which adaptive execution splits, and never one group.
    """
    if larger:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select("u", "v")
    lowest = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = around.join(lowest, "u")
    if larger:
        pairs = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        pairs = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
    return pairs.where("u <> v").distinct()


def components(links: DataFrame, name: str) -> DataFrame:
    """``node``, ``root`` for every node of ``links`` (u, v): root is the smallest node it is connected with.

    Large-star and small-star steps alternate until the links no longer change; every round is written to the
    shared folder. Links are undirected; loops and repeats are harmless, nodes without links have no row.
    """
    edges = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .distinct(), name)

    def mark(table: DataFrame):
        return tuple(table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(edges)
    while seen[0]:
        edges = stored(_star(_star(edges, True), False), name)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
