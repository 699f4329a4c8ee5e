"""Connected components by rounds of large-star and small-star steps.

A step replaces each node's edges by edges to the smallest node it knows. Minima are taken by
aggregates, which fold before the shuffle, and kept as a table, so that the join back is one
of two plain shuffles whose hot keys Spark splits. Nothing but two counters reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.scratch import Scratch


def star(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v, m) for each pair (u, v): m is the smallest of u and the nodes paired with it."""
    least = scratch.keep(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return pairs.join(least, "u")


def local_roots(left, right, n: int):
    """Smallest index that each of ``n`` nodes reaches over the given edges, by numpy."""
    import numpy as np

    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            return root


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the root is the smallest node it is connected to.

    Repeated edges, loops and either direction are fine; edges with a null end count for
    nothing. No edges: an empty table.
    """
    now = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = scratch.keep(star(both, scratch).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = star(large, scratch)
        now = scratch.keep(small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
                           .select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct())
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
