"""Chains and subtrees by doubling, against plain walks."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from changerisk.operators import catalogs, recursion


def test_a_chain_of_ten_thousand_links(spark, monkeypatch):
    rounds = []
    cut = recursion.cut_lineage
    monkeypatch.setattr(recursion, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    n = 10_000
    chain = spark.range(n).select(
        F.lit(1).alias("db_id"), F.col("id").alias("node"),
        F.when(F.col("id") < n - 1, F.col("id") + 1).alias("next"), F.lit(1).alias("one"),
        (F.col("id") == n - 1).alias("flag"))
    got = recursion.fold_chains(chain, ["db_id"], ["one"], ["flag"]).where(
        "node IN (0, 17, 9999)").orderBy("node").collect()
    assert [tuple(r)[1:] for r in got] == [
        (0, 9999, 9999, 10_000, True), (17, 9999, 9982, 9983, True), (9999, 9999, 0, 1, True)]
    assert len(rounds) < 20
    rounds.clear()
    tree = chain.withColumnRenamed("next", "parent")
    top = recursion.fold_subtrees(tree, ["db_id"], ["one"]).where("node = 9999").first()
    assert top["one"] == n and len(rounds) < 20


def test_random_trees_with_a_wide_node(spark):
    rng = random.Random(4)
    parent = {i: (None if i % 50 == 0 else 0 if i % 3 == 0 else rng.randrange(i)) for i in range(600)}
    parent[77] = 10_000  # leads nowhere
    rows = [(d, i, p, i * d, i % 7 == 0) for d in (1, 2) for i, p in parent.items()]
    df = spark.createDataFrame(rows, "db_id int, node long, parent long, size long, odd boolean")
    want, chains = {}, {}
    for d, i, _, _, _ in rows:
        at, way = i, [i]
        while parent[at] in parent:
            at = parent[at]
            way.append(at)
        chains[d, i] = (at, len(way) - 1, sum(k * d for k in way), any(k % 7 == 0 for k in way))
        for k in way:
            want[d, k] = want.get((d, k), 0) + i * d
    got = recursion.fold_subtrees(df, ["db_id"], ["size"]).collect()
    assert {(r["db_id"], r["node"]): r["size"] for r in got} == want
    got = recursion.fold_chains(df.withColumnRenamed("parent", "next"), ["db_id"], ["size"],
                                ["odd"]).collect()
    assert {(r["db_id"], r["node"]): tuple(r)[2:] for r in got} == chains


def test_cycles_end_and_have_no_result(spark):
    df = spark.createDataFrame([(1, 1, 2, 5), (1, 2, 1, 5), (1, 3, 1, 5), (1, 4, None, 5)],
                               "db_id int, node long, next long, v long")
    last = {r["node"]: r["last"] for r in recursion.fold_chains(df, ["db_id"], ["v"], []).collect()}
    assert last == {1: None, 2: None, 3: None, 4: 4}
    sums = {r["node"]: r["v"] for r in recursion.fold_subtrees(
        df.withColumnRenamed("next", "parent"), ["db_id"], ["v"]).collect()}
    assert sums == {1: None, 2: None, 3: None, 4: 5}
    assert recursion.fold_chains(df.where("false"), ["db_id"], ["v"], []).collect() == []


def test_totals_of_a_node_with_two_parents(spark):
    def totals(links):
        inherits = spark.createDataFrame([(1, c, p) for c, p in links],
                                         "db_id int, inhrelid long, inhparent long")
        roots = spark.createDataFrame([(1, i) for i in range(6)], "db_id int, oid long")
        sizes = spark.createDataFrame([(1, i, 10 ** i) for i in range(5)],
                                      "db_id int, oid long, total_bytes long")
        return {r["root"]: (r["partitions"], r["total_bytes"]) for r in
                catalogs.partition_totals(roots, inherits, sizes).collect()}

    tree = [(1, 0), (2, 0), (3, 1), (4, 1)]
    assert totals(tree) == {0: (4, 11110), 1: (2, 11000), 2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (0, 0)}
    assert totals([*tree, (4, 2)]) == {0: (4, 11110), 1: (2, 11000), 2: (1, 10000), 3: (0, 0),
                                       4: (0, 0), 5: (0, 0)}
