"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import discard, stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (node, smallest node it reaches) that keep the components of the links ``a``-``b``."""
    if not len(a):
        return a, b
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = codes[: len(a)], codes[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links (u, v) with u > v."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node reachable.

    Links may repeat, stand in either order and link a node with itself (a node that has only such links is
    left out).  Each round is written to the shared folder and replaces the one before; rounds grow with the logarithm of the longest chain.
    """
    a, b = F.col("a"), F.col("b")
    links = edges.where("a != b").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = stored(links, purpose)
    mark = None
    while True:
        row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if row == mark or not row["n"]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, before = row, links
        links = stored(_round(links), purpose)
        discard(before)
