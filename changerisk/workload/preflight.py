"""Data checks over orders, line items and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from changerisk.operators import preflight as pf
from changerisk.workload.adapters import table
from changerisk.workload.registry import query


@query("foreign_key_orphans", """
SELECT l_orderkey AS l_orderkey, count(*) AS row_count FROM lineitem
WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN
  (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0)
GROUP BY l_orderkey""")
def foreign_key_orphans(spark, sf):
    parent = table(spark, sf, "orders").select("o_orderkey").filter("o_orderkey % 10 <> 0")
    child = table(spark, sf, "lineitem").select("l_orderkey")
    return pf.orphan_keys(child, parent, {"l_orderkey": "o_orderkey"}).withColumnRenamed(
        "rows", "row_count")


@query("foreign_key_orphan_rows", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem l
WHERE l_partkey IS NOT NULL AND NOT EXISTS
  (SELECT 1 FROM part WHERE p_partkey = l.l_partkey AND p_partkey % 50 <> 0)""")
def foreign_key_orphan_rows(spark, sf):
    parent = table(spark, sf, "part").select("p_partkey").filter("p_partkey % 50 <> 0")
    child = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey",
                                                "l_linenumber")
    return pf.orphan_rows(child, parent, {"l_partkey": "p_partkey"})


@query("composite_foreign_key_orphans", """
SELECT k AS region_key, s AS status, count(*) AS row_count
FROM (SELECT NULLIF(o_custkey % 13, 0) AS k, NULLIF(o_orderstatus, 'F') AS s FROM orders)
WHERE k IS NOT NULL AND s IS NOT NULL AND (k, s) NOT IN
  (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'O' ELSE 'P' END FROM nation)
GROUP BY 1, 2""")
def composite_foreign_key_orphans(spark, sf):
    child = table(spark, sf, "orders").selectExpr(
        "nullif(o_custkey % 13, 0) AS region_key", "nullif(o_orderstatus, 'F') AS status")
    parent = table(spark, sf, "nation").selectExpr(
        "cast(n_nationkey AS bigint) AS k", "if(n_nationkey % 2 = 0, 'O', 'P') AS s")
    return pf.orphan_keys(child, parent, {"region_key": "k", "status": "s"}).withColumnRenamed(
        "rows", "row_count")


@query("not_null_violations", """
SELECT * FROM (
  SELECT 'o_orderstatus' AS column_name, count(*) FILTER (WHERE o_orderstatus = 'F') AS null_rows,
         count(*) AS row_count FROM orders
  UNION ALL SELECT 'o_totalprice', count(*) FILTER (WHERE o_totalprice IS NULL), count(*) FROM orders
  UNION ALL SELECT 'o_custkey', count(*) FILTER (WHERE o_custkey % 7 = 0), count(*) FROM orders)""")
def not_null_violations(spark, sf):
    orders = table(spark, sf, "orders").selectExpr(
        "nullif(o_orderstatus, 'F') AS o_orderstatus", "o_totalprice",
        "if(o_custkey % 7 = 0, NULL, o_custkey) AS o_custkey")
    return pf.null_counts(orders, ["o_orderstatus", "o_totalprice", "o_custkey"]).select(
        F.col("column").alias("column_name"), F.col("nulls").alias("null_rows"),
        F.col("rows").alias("row_count"))


@query("check_violations", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE NOT (CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END < 45)""")
def check_violations(spark, sf):
    condition = F.when(F.col("l_linenumber") != 7, F.col("l_quantity")) < 45
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return pf.check_violations(li, condition)


@query("unique_violations", """
SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def unique_violations(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return pf.duplicate_keys(li, ["l_orderkey", "l_linenumber"]).withColumnRenamed(
        "rows", "row_count")


@query("partial_unique_violations", """
SELECT l_partkey, s AS supplier, count(*) AS row_count
FROM (SELECT l_partkey, NULLIF(l_suppkey, 3) AS s, l_returnflag FROM lineitem)
WHERE l_returnflag = 'R' AND s IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def partial_unique_violations(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr(
        "l_partkey", "nullif(l_suppkey, 3) AS supplier", "l_returnflag")
    return pf.duplicate_keys(li, ["l_partkey", "supplier"],
                             F.col("l_returnflag") == "R").withColumnRenamed("rows", "row_count")


@query("primary_key_problems", """
SELECT CAST(coalesce(sum(n) FILTER (WHERE k IS NULL), 0) AS BIGINT) AS null_rows,
       count(*) FILTER (WHERE k IS NOT NULL AND n > 1) AS duplicate_keys,
       CAST(coalesce(sum(n) FILTER (WHERE k IS NOT NULL AND n > 1), 0) AS BIGINT)
         AS duplicate_rows
FROM (SELECT NULLIF(l_orderkey % 5, 0) * 1000000 + l_partkey AS k, count(*) AS n
      FROM lineitem GROUP BY 1)""")
def primary_key_problems(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr(
        "nullif(l_orderkey % 5, 0) * 1000000 + l_partkey AS k")
    return pf.primary_key_problems(li, ["k"])


@query("type_change_losses", """
SELECT 'c_name' AS column_name, 'varchar(17)' AS new_type,
       count(*) FILTER (WHERE length(rtrim(c_name)) > 17) AS failing,
       count(*) FILTER (WHERE length(rtrim(c_name)) <= 17 AND length(c_name) > 17) AS lossy
FROM (SELECT substr(c_name, 1, 16 + CAST(c_custkey % 3 AS INT)) || CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE '' END AS c_name FROM customer)
UNION ALL
SELECT 'c_acctbal', 'int', 0,
       count(*) FILTER (WHERE trunc(c_acctbal) <> c_acctbal) FROM customer
UNION ALL
SELECT 'c_custkey', 'smallint', count(*) FILTER (WHERE c_custkey * 40 > 32767), 0 FROM customer
UNION ALL
SELECT 'c_code', 'bigint', count(*) FILTER (WHERE c_custkey % 5 = 0), 0 FROM customer""")
def type_change_losses(spark, sf):
    customers = table(spark, sf, "customer").selectExpr(
        "concat(substr(c_name, 1, 16 + cast(c_custkey % 3 AS int)), "
        "       if(c_custkey % 4 = 0, '  ', '')) AS c_name",
        "c_acctbal", "c_custkey * 40 AS c_custkey",
        "if(c_custkey % 5 = 0, 'x', '') || cast(c_custkey AS string) AS c_code")
    return pf.type_change_losses(customers, {
        "c_name": "varchar(17)", "c_acctbal": "int", "c_custkey": "smallint",
        "c_code": "bigint"}).withColumnRenamed("column", "column_name")


@query("empty_table_check", """
SELECT 'orders' AS table_name, count(*) = 0 AS is_empty FROM orders
UNION ALL SELECT 'cancelled', count(*) = 0 FROM orders WHERE o_orderstatus = 'X'""")
def empty_table_check(spark, sf):
    orders = table(spark, sf, "orders")
    whole = pf.is_empty(orders).withColumn("table_name", F.lit("orders"))
    none = pf.is_empty(orders.filter("o_orderstatus = 'X'")).withColumn(
        "table_name", F.lit("cancelled"))
    return whole.unionByName(none).select("table_name", "is_empty")


@query("backfill_volume", """
SELECT count(*) AS row_count, count(*) FILTER (WHERE o_orderstatus = 'P') AS matched,
       count(*) FILTER (WHERE o_orderstatus = 'P') * 1000 // count(*) AS per_mille
FROM orders""")
def backfill_volume(spark, sf):
    return pf.backfill_volume(table(spark, sf, "orders"),
                              F.col("o_orderstatus") == "P").withColumnRenamed(
        "rows", "row_count")


@query("backfill_windows", """
SELECT o_orderkey // 10000 * 10000 AS lo, o_orderkey // 10000 * 10000 + 10000 AS hi,
       count(*) AS matched FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2""")
def backfill_windows(spark, sf):
    return pf.window_volume(table(spark, sf, "orders"), "o_orderkey", 10000,
                            F.col("o_orderstatus") == "P")


@query("key_windows", """
WITH k AS (SELECT l_orderkey AS k, count(*) AS m FROM lineitem GROUP BY 1),
r AS (SELECT k, m, CAST(coalesce(sum(m) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), 0) AS BIGINT) // 1000 AS w FROM k)
SELECT w AS window_no, min(k) AS lo, max(k) + 1 AS hi, CAST(sum(m) AS BIGINT) AS row_count
FROM r GROUP BY w""")
def key_windows(spark, sf):
    return pf.key_windows(table(spark, sf, "lineitem").select("l_orderkey"), "l_orderkey",
                          1000).withColumnRenamed("rows", "row_count")


@query("relation_profile", """
SELECT 'o_orderstatus' AS column_name, count(*) AS row_count,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS null_rows,
       CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE strlen(o_orderstatus) END) AS BIGINT)
         AS bytes,
       CAST(count(DISTINCT NULLIF(o_orderstatus, 'F')) AS BIGINT) AS distinct_values FROM orders
UNION ALL
SELECT 'o_orderpriority', count(*), 0, CAST(sum(strlen(o_orderpriority)) AS BIGINT),
       count(DISTINCT o_orderpriority) FROM orders""")
def relation_profile(spark, sf):
    orders = table(spark, sf, "orders").selectExpr(
        "nullif(o_orderstatus, 'F') AS o_orderstatus", "o_orderpriority")
    return pf.relation_profile(orders, ["o_orderstatus", "o_orderpriority"]).select(
        F.col("column").alias("column_name"), F.col("rows").alias("row_count"),
        F.col("nulls").alias("null_rows"), "bytes",
        F.col("distinct_estimate").alias("distinct_values"))


@query("drop_impact", """
WITH RECURSIVE e AS (
  SELECT DISTINCT c_custkey // 3 AS parent, c_custkey AS child FROM customer
  WHERE c_custkey > 0),
walk AS (
  SELECT n_nationkey AS root, CAST(n_nationkey AS BIGINT) AS rel, 0 AS d FROM nation
  UNION
  SELECT w.root, e.child, w.d + 1 FROM walk w JOIN e ON e.parent = w.rel)
SELECT root, rel AS relation, min(d) AS distance FROM walk GROUP BY 1, 2 HAVING min(d) > 0""")
def drop_impact(spark, sf):
    edges = table(spark, sf, "customer").selectExpr(
        "1 AS db_id", "c_custkey div 3 AS parent", "c_custkey AS child")
    roots = table(spark, sf, "nation").selectExpr("1 AS db_id",
                                                  "cast(n_nationkey AS bigint) AS relation")
    return pf.drop_impact(edges, roots, ["db_id"]).drop("db_id")


@query("exclusion_conflicts", """
WITH r AS (SELECT user_id, event_id, ts AS lo, ts + to_minutes(CAST(floor(value) AS INT)) AS hi
           FROM events WHERE floor(value) > 0),
s AS (SELECT *, max({'hi': hi, 'neg': -event_id}) OVER (
        PARTITION BY user_id ORDER BY lo, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r)
SELECT user_id, event_id, -m.neg AS conflicts_with FROM s WHERE m.hi > lo""")
def exclusion_conflicts(spark, sf):
    events = table(spark, sf, "events").selectExpr(
        "user_id", "event_id", "ts AS lo",
        "ts + make_dt_interval(0, 0, cast(floor(value) AS int), 0) AS hi")
    chunk = F.datediff(F.col("lo"), F.lit("2000-01-01").cast("date"))
    return pf.overlapping_rows(events, ["user_id"], "lo", "hi", "event_id", chunk).select(
        "user_id", "event_id", "conflicts_with")


@query("attach_partition_check", """
SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND NOT coalesce(
          o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1999-01-01', false))
         AS outside,
       (SELECT count(*) FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F' AND
          o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1999-01-01')
         AS in_default""")
def attach_partition_check(spark, sf):
    orders = table(spark, sf, "orders")
    lo, hi = (F.lit(d).cast("timestamp_ntz") for d in ("1995-01-01", "1999-01-01"))
    attached = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))
    return pf.attach_check(orders.filter(attached), orders.filter(~attached), "o_orderdate",
                           lo, hi)


@query("update_from_preview", """
SELECT o.o_orderkey, o.o_totalprice AS old_value, m.new_value, m.matches
FROM orders o JOIN (SELECT l_orderkey, count(*) AS matches, min(l_extendedprice) AS new_value
                    FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) m
ON o.o_orderkey = m.l_orderkey""")
def update_from_preview(spark, sf):
    source = table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select(
        "l_orderkey", "l_extendedprice")
    target = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    out = pf.update_preview(target.withColumn("k", F.col("o_orderkey")), source,
                            {"k": "l_orderkey"}, "o_orderkey", "o_totalprice", "l_extendedprice")
    return out
