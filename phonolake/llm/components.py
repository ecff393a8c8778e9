"""Connected components by alternating large and small stars, all in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.session import materialise


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member of its component) for the links a-b of one task, roots left out."""
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = codes[: len(a)], codes[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all() and (label[a] == label[b]).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def connected(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``u``, ``v`` longs) that is not its component's smallest.

    Each round writes its links to the shared folder; the number of rounds grows with
    the logarithm of the nodes. The smallest neighbours are written before they are joined,
    so that adaptive execution can split a node with very many links.
    """
    edges = materialise(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "smallest")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(large.filter("u <> v").distinct(), "large")
        low = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "smallest")
        small = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v")
        edges = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small")
        seen = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if seen == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = seen
