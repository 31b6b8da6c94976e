"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changerisk.llm.scratch import Scratch


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is its smallest node.

    Alternating star contractions (Kiveris et al., 2014). Each round hangs the
    larger neighbours of every node, then the smaller ones, on its smallest
    neighbour, until every node hangs on the smallest node of its component;
    the rounds grow with the logarithm of the longest path. Every table has two
    columns and at most as many rows as there are edges; smallest neighbours
    are folded before the shuffle, and joins on a node with very many edges are
    left to Spark's splitting of skewed partitions. Rounds are written to the
    shared folder and dropped again. Loops are kept as nodes without a
    neighbour; null ends drop the edge. Without edges the result is empty.
    """
    scratch = Scratch(edges.sparkSession)
    pairs = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    links, path = scratch.keep(pairs.select(F.greatest("a", "b").alias("a"),
                                            F.least("a", "b").alias("b")).distinct())
    nodes, _ = scratch.keep(links.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    links = links.where("a <> b")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        large, large_path = scratch.keep(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        small, small_path = scratch.keep(small)
        scratch.drop(path)
        scratch.drop(large_path)
        links, path = small, small_path
        now = links.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            break
        before = now
    return nodes.join(links.select(F.col("a").alias("node"), "b"), "node", "left").select(
        "node", F.coalesce("b", "node").alias("component"))
