"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from newsloom.session import cut, discard


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst") % (1 << 40)).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (src, dst); a component is
    named by its smallest node.

    Alternates two contractions: first every larger neighbour of a node is tied
    to the smallest node around it, then every node and its smaller neighbours
    are. The number of rounds grows with the logarithm of the longest path. A
    node's smallest neighbour is found by a two-step aggregate and joined back,
    so a hub is split by the skew join instead of being collected.
    """
    pairs = edges.filter(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    pairs = cut(pairs)
    before = _signature(pairs)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        older, pairs = pairs, cut(_tie_smaller(_tie_larger(pairs)))
        discard(older)
        after = _signature(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    stars = pairs.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    centres = pairs.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return stars.unionByName(centres)


def _tie_larger(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(
        pairs.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(smallest, "u").select(
        F.col("v").alias("src"), F.col("m").alias("dst")).distinct()


def _tie_smaller(pairs: DataFrame) -> DataFrame:
    smallest = pairs.groupBy("src").agg(F.min("dst").alias("m"))
    tied = pairs.join(smallest, "src")
    return tied.select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(
        smallest.select("src", F.col("m").alias("dst"))).filter("src <> dst").distinct()


def join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of the pairs (i, j), in place: `label` has one node of its
    component for each node, the same for all of them."""
    while True:
        across = label[i] != label[j]
        if not across.any():
            break
        i, j = i[across], j[across]
        np.minimum.at(label, np.maximum(label[i], label[j]), np.minimum(label[i], label[j]))
        while (label[label] != label).any():
            label[:] = label[label]


def forest(n: int, pieces) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (i, j) in pieces enough to join what they all join: a node is tied
    to the smallest of its component."""
    label = np.arange(n)
    for i, j in pieces:
        join(label, i, j)
    tied = np.flatnonzero(label != np.arange(n))
    return tied, label[tied]
