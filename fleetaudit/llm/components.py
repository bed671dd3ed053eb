"""Connected components by alternating stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _least(pairs: DataFrame, name: str) -> DataFrame:
    """u and m, the smaller of u and its least neighbour v, as a table: a join with it can split a hot u."""
    return written(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)


def stars(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node but the roots, by union-find in rounds: every node hands its larger neighbours
    (large star) and then its smaller ones (small star) to the least node it knows, until nothing changes. Each round
    is a minimum per node, combined before the shuffle, and an equi-join; the links shrink to one per node.

    Tables below the checkpoint folder cut the lineage each round."""
    current = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
                      .select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), "links")
    while True:
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both, "least_large")
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.where("m < u").select("u", F.col("m").alias("v"))))
        down = written(large.where("u > v").distinct(), "large_star")
        least = _least(down, "least_small")
        small = (down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.where("m < u").select("u", F.col("m").alias("v"))))
        current = written(small.where("u > v").distinct(), "small_star")
        # finished when every node has one link and no root is itself a child
        many = current.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not many and not current.join(current.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, least) with root, the least node of its component, and ``least`` lowered to the smallest in it. A
    node without links is its own root. ``edges`` has columns a and b."""
    rooted = written(nodes.join(stars(edges), "node", "left")
                     .select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    best = written(rooted.groupBy("root").agg(F.min("least").alias("best")), "component_least")
    return rooted.join(best, "root").select("node", "root", F.col("best").alias("least"))
