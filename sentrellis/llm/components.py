"""Connected components of a distributed edge list by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the node, so a hub of any size is pre-aggregated before it is
shuffled and its edges can be split by the planner. No edge, node or label comes to the driver; each round's
edges are written to the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what the links a-b connect."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b) with a > b: larger neighbours, or the node and its smaller ones, join the least."""
    sides = edges.select("a", "b")
    if large:
        sides = sides.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(sides.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")))
    least = least.withColumn("least", F.least("node", "least"))
    joined = sides.join(least, F.col("a") == F.col("node"))
    out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")) if large else joined.select(F.explode(F.array(F.struct(F.col("a"), F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e")).select("e.*")
    return out.filter("a > b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)`` that is not the smallest of its component."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    state = None
    for _ in range(most_rounds):
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if tuple(now) == state or not now["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(now)
        edges = materialise(_star(materialise(_star(edges, True)), False))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
