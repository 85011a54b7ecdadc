"""Connected components of links, as Spark joins and sums.

Each round turns the links into stars around the smallest neighbour, first of larger and then of
smaller nodes (alternating stars), until nothing changes; the number of rounds grows with the
logarithm of the longest chain. A node's smallest neighbour is found by a minimum that is
added up before the shuffle, and joins deal a node with many links to several tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import split_join, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what the links (a, b) of one task connect: each node but the smallest of its
    component, with that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
    far = split_join(both.where("b > a"), least, ["a"], total, ["b"]).where("b != m")
    return far.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    near = split_join(down, least, ["a"], total, ["b"]).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is its component's smallest node.

    Links to oneself or with a null are left out; repeated links do no harm. No link gives no row.
    """
    rows = written(links.select(F.col("a"), F.col("b")).where("a != b").distinct())
    mark, n = None, rows.count()
    while True:
        rows = written(_small_star(written(_large_star(rows, n)), n))
        seen = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark, n = tuple(seen), seen[0]
    return rows.select(F.col("a").alias("node"), F.col("b").alias("root")).union(rows.select("b", "b").distinct())
