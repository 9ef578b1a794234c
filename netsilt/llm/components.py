"""Connected components of a graph in DataFrames, and of one block in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsilt.llm.common import stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b within one block as (node, smallest node of its component), the
    roots themselves left out: at most one row per node."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = inverse[: len(a)], inverse[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(least, label[a], low)
        np.minimum.at(least, label[b], low)
        least = least[least]
        least = np.minimum(least, least[label])
        if (least == label).all():
            break
        label = least
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``: root is its component's
    smallest node. Alternates the large-star and small-star steps, in which every
    node links its neighbours to the smallest one it knows; edges never become more.
    A round ends in a written table, so lineage stays short and nothing is collected.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                   "edges")
    for _ in range(rounds):
        near = both(state)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = near.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a != b").distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
                      ).alias("e")).select("e.*").filter("a != b").distinct()
        small = stored(small, "edges")
        # a star: no node is both a leaf and a root
        if small.join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty() and \
                small.groupBy("a").count().filter("count > 1").isEmpty():
            return small.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                small.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = small
    raise RuntimeError(f"components did not settle in {rounds} rounds")
