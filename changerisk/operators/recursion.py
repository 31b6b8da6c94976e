"""Walks over parent links.

Where every node has one parent, rounds double the distance covered, so their
number is the logarithm of the depth and each round's table has a row per node.
Walks over any links go level by level. Each round is written out before the
next, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changerisk.session import cut_lineage


def descend(start: DataFrame, links: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """All nodes below or beyond the start nodes, with their least depth.

    ``start(keys, carry.., node)``; ``links(keys, node, next)``. Depth 0 is the
    start itself. A level holds only what no level before it reached, so the
    walk ends with the first empty level, cycles included, however deep.
    """
    columns = [*keys, *carry, "node"]
    level = cut_lineage(start.select(*columns).distinct().withColumn("depth", F.lit(0)))
    reached, depth = level, 0
    while not level.isEmpty():
        depth += 1
        found = (level.select(*columns).join(links, [*keys, "node"])
                 .select(*keys, *carry, F.col("next").alias("node")).distinct())
        known = reached.select(*[F.col(c).alias(f"__{c}") for c in columns])
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]
        level = cut_lineage(found.join(known, same, "left_anti")
                            .withColumn("depth", F.lit(depth)))
        reached = reached.unionByName(level)
    return reached


def _most_rounds(nodes: int) -> int:
    """Rounds after which only nodes that lead into a cycle are still on their way."""
    return max(1, math.ceil(math.log2(nodes + 1))) + 1


def fold_chains(nodes: DataFrame, keys: list[str], sums: list[str], flags: list[str]) -> DataFrame:
    """Every node with the end of its chain and what the nodes on the way add up to.

    ``nodes(keys, node, next, sums.., flags..)`` has one row per node; ``next`` is
    NULL, or leads nowhere, at the end of a chain. Returns ``keys, node, last,
    depth``, the sums and whether any flag on the way is set, the node's own
    included. ``last`` is NULL for nodes that lead into a cycle.
    """
    there = nodes.select(*keys, F.col("node").alias("next"), F.lit(True).alias("__there"))
    values = [*[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in sums],
              *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in flags]]
    state = cut_lineage(nodes.join(there, [*keys, "next"], "left").select(
        *keys, "node", F.when(F.col("__there"), F.col("next")).alias("jump"),
        F.col("node").alias("last"), F.lit(0).cast("bigint").alias("depth"), *values))
    for _ in range(_most_rounds(state.count())):
        going = state.where("jump IS NOT NULL")
        if going.isEmpty():
            break
        ahead = state.select(*keys, F.col("node").alias("jump"), *[
            F.col(c).alias(f"__{c}") for c in ("jump", "last", "depth", *sums, *flags)])
        moved = going.join(ahead, [*keys, "jump"]).select(
            *keys, "node", F.col("__jump").alias("jump"), F.col("__last").alias("last"),
            (F.col("depth") + F.col("__depth") + 1).alias("depth"),
            *[(F.col(c) + F.col(f"__{c}")).alias(c) for c in sums],
            *[(F.col(c) | F.col(f"__{c}")).alias(c) for c in flags])
        state = cut_lineage(state.where("jump IS NULL").unionByName(moved))
    return state.select(*keys, "node", F.when(F.col("jump").isNull(), F.col("last")).alias("last"),
                        "depth", *sums, *flags)


def fold_subtrees(nodes: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Every node with the sums of its own values and of all below it.

    ``nodes(keys, node, parent, sums..)`` has one row per node. In round k each
    node passes what it has gathered to the node 2 to the k levels up, folded
    before the shuffle, so a parent of very many is no hot key. Nodes that lead
    into a cycle have NULL sums.
    """
    there = nodes.select(*keys, F.col("node").alias("parent"), F.lit(True).alias("__there"))
    state = cut_lineage(nodes.join(there, [*keys, "parent"], "left").select(
        *keys, "node", F.when(F.col("__there"), F.col("parent")).alias("jump"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in sums]))
    for _ in range(_most_rounds(state.count())):
        going = state.where("jump IS NOT NULL")
        if going.isEmpty():
            break
        passed = going.groupBy(*keys, F.col("jump").alias("node")).agg(
            *[F.sum(c).alias(f"__{c}") for c in sums])
        ahead = state.select(*keys, F.col("node").alias("jump"), F.col("jump").alias("__jump"))
        state = cut_lineage(
            state.join(passed, [*keys, "node"], "left").join(ahead, [*keys, "jump"], "left").select(
                *keys, "node", F.col("__jump").alias("jump"),
                *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in sums]))
    return state.select(*keys, "node", *[F.when(F.col("jump").isNull(), F.col(c)).alias(c)
                                         for c in sums])
