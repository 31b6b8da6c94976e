"""One key holding a third of all rows: same results, spread over many tasks."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from changerisk.operators import distribution as d
from changerisk.operators import evaluate, order, preflight, recursion
from changerisk.seeds import tables


@pytest.fixture(scope="module")
def hot(spark):
    """30,000 rows; key 0 holds half of them."""
    return spark.range(30_000).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 40).alias("k"),
        F.col("id").alias("i"), (F.col("id") * 7919 % 1009).alias("v")).cache()


def test_prefix_scan_equals_one_window(spark, hot):
    scanned = d.prefix_scan(hot, ["k"], ["i"], F.floor(F.col("i") / 512), {
        "total": ("sum", F.col("v")), "high": ("max", F.col("v")), "low": ("min", F.col("v")),
        "latest": ("last", F.when(F.col("v") % 5 == 0, F.col("v")))})
    hot.createOrReplaceTempView("hot")
    expected = spark.sql("""
        SELECT k, i, v, sum(v) OVER w total, max(v) OVER w high, min(v) OVER w low,
               last(if(v % 5 = 0, v, NULL), true) OVER w latest FROM hot
        WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING
                     AND 1 PRECEDING)""")
    assert scanned.exceptAll(expected).isEmpty() and expected.exceptAll(scanned).isEmpty()


def test_prefix_scan_never_partitions_rows_by_key_alone(hot):
    scanned = d.prefix_scan(hot, ["k"], ["i"], F.floor(F.col("i") / 512),
                            {"total": ("sum", F.col("v"))})
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "windowspec" in line]
    assert len(windows) == 2
    row_window = next(w for w in windows if "__in_total" in w)
    assert "__chunk" in row_window.split("specifiedwindowframe")[-1] or "__chunk" in row_window


@pytest.mark.parametrize("value", [
    lambda i: 1_700_000_000_000.0 + (i * 7919) % 2_592_000_000,  # milliseconds of one month
    lambda i: ((i * 7919) % 9973) / 9973.0,  # ratios
    lambda i: 5.0 if i % 3 else -float(i),
    lambda i: 1e9 if i == 7 else (i % 977) / 1e6])
def test_order_statistics_of_narrow_values(spark, value):
    rows = [(i % 2, value(i)) for i in range(5000)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r["k"]: r["median"] for r in d.medians(df, ["k"], "v").collect()}
    for k in (0, 1):
        assert got[k] == statistics.median(v for key, v in rows if key == k)


def test_one_slot_of_a_narrow_key_is_sorted_alone(spark):
    df = spark.range(20_000).selectExpr("1 AS k", "1700000000000 + id * 130 AS v")
    plan = d.medians(df, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert any("__s" in line for line in plan.splitlines() if "Window" in line)


def test_windows_of_sparse_keys(spark):
    df = spark.range(2000).selectExpr("id * 4611686018427387 AS k")
    got = preflight.key_windows(df, "k", 100).collect()
    assert len(got) == 20 and {r["rows"] for r in got} == {100}
    with pytest.raises(ValueError, match="whole number"):
        preflight.key_windows(df.selectExpr("string(k) AS k"), "k", 100)


def test_walks_of_any_depth_and_cycles(spark):
    links = spark.createDataFrame([(1, i, i + 1) for i in range(40)] + [(1, 40, 38), (1, 5, 5)],
                                  "db_id int, node int, next int")
    start = spark.createDataFrame([(1, "r", 0), (1, "s", 39)], "db_id int, root string, node int")
    got = {(r["root"], r["node"]): r["depth"]
           for r in recursion.descend(start, links, ["db_id"], ["root"]).collect()}
    assert got == {("r", i): i for i in range(41)} | {("s", 39): 0, ("s", 40): 1, ("s", 38): 2}


def test_factor_falls_back_to_all_probes(spark):
    case, where = tables.COMPARABLE_PROBES[0]
    readings = spark.createDataFrame(
        [("p", case, where, 5, 50), ("p", "other", "t", 5, 300), ("q", case, where, 6, 50)],
        "pass_id string, case_id string, table string, at_s int, today_ms int")
    reference = spark.createDataFrame([("other", "t", 100), (case, where, None)],
                                      "case_id string, table string, reference_ms int")
    got = {r["pass_id"]: r["factor"]
           for r in evaluate.comparable_factors(readings, reference).collect()}
    assert got == {"p": 3.0, "q": 1.0}


def test_medians_match_python(hot):
    values: dict[int, list[int]] = {}
    for row in hot.collect():
        values.setdefault(row["k"], []).append(row["v"])
    got = {r["k"]: r["median"] for r in d.medians(hot, ["k"], "v").collect()}
    assert got == {k: statistics.median(v) for k, v in values.items()}


def test_order_statistics_with_negative_and_fractional_values(spark):
    random.seed(1)
    numbers = [random.uniform(-1e6, 1e6) for _ in range(999)] + [0.0, -0.5, 0.25]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    row = d.order_statistics(df, [], "x", {
        "least": F.lit(0), "p90": F.floor(F.col("n") * 0.9), "most": F.col("n") - 1}).first()
    ordered = sorted(numbers)
    assert (row["least"], row["p90"], row["most"]) == (
        ordered[0], ordered[int(len(ordered) * 0.9)], ordered[-1])


def test_orphans_are_counted_before_the_join(spark, hot):
    parent = spark.range(1, 40).select(F.col("id").alias("p")).filter("p <> 7")
    found = preflight.orphan_keys(hot, parent, {"k": "p"})
    assert {r["k"]: r["rows"] for r in found.collect()} == {0: 15_000, 7: 750}
    # with a parent too large to broadcast, keys are folded before the join
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = preflight.orphan_keys(hot, parent, {"k": "p"})
        plan = again._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join LeftAnti") < plan.index("Aggregate")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_overlaps_give_one_row_per_rejected_row(spark):
    # a thousand identical ranges: 499,500 pairs, but 999 rejected rows
    df = spark.range(1000).select(F.lit(1).alias("k"), F.lit(0).alias("lo"),
                                  F.lit(10).alias("hi"), "id")
    out = preflight.overlapping_rows(df, ["k"], "lo", "hi", "id", F.col("lo"))
    assert out.count() == 999
    touching = spark.createDataFrame([(1, 0, 5, 1), (1, 5, 9, 2), (1, 8, 12, 3)],
                                     "k int, lo int, hi int, id int")
    rows = preflight.overlapping_rows(touching, ["k"], "lo", "hi", "id", F.col("lo")).collect()
    assert [(r["id"], r["conflicts_with"]) for r in rows] == [(3, 2)]


def test_one_huge_file_keeps_its_transaction_state(spark):
    # one file, a block opened at the start of every thousand statements
    statements = spark.range(200_000).select(
        F.lit("f").alias("file_id"), F.col("id").alias("idx"), F.lit(0).alias("inner_pos"),
        F.when(F.col("id") % 1000 == 0, "begin").when(F.col("id") % 1000 == 400, "commit")
        .otherwise("select").alias("kind"), F.create_map(F.lit("chain"), F.lit("false")
                                                         ).alias("attrs"))
    state = order.transaction_state(statements)
    assert state.filter("explicit").count() == 200 * 399
    assert state.filter("explicit").select("block_id").distinct().count() == 200
