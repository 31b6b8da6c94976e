"""Catalog facts from exported system catalogs.

The catalogs are derived from the given tables: relations from orders, columns
and indexes from line items, types and functions from parts, partition trees
from customers, activity from events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.operators import catalogs as cg
from changerisk.operators.rules import explode_units

from changerisk.workload import adapters
from changerisk.workload.adapters import pick, pick_sql, table
from changerisk.workload.registry import query
from changerisk.workload.sqltext import CORPUS, UNITS, cte


def text(column: Column) -> Column:
    return column.cast("string")


def value(fact: str, default: object = -1) -> Column:
    return F.coalesce(F.col(f"{fact}.value"), F.lit(default)).alias(fact)


def pg_class(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        (k % 5).alias("db_id"), k.alias("oid"), F.concat(F.lit("r"), text(k)).alias("relname"),
        (F.col("o_custkey") % 25).alias("relnamespace"),
        F.lower("o_orderstatus").alias("relkind"), (k * 3).alias("relpages"),
        F.when(k % 7 == 0, -1).otherwise(F.floor("o_totalprice")).cast("bigint").alias(
            "reltuples"),
        (k % 3).alias("relam"), k)


def pg_namespace(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("oid"),
        F.when(F.col("n_nationkey") == 0, "public").otherwise(F.lower("n_name")).alias("nspname"))
    return n.select(F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(5)])).alias("db_id"),
                    "oid", "nspname")


_CLASS = """
cls AS (SELECT o_orderkey % 5 AS db_id, o_orderkey AS oid, 'r' || CAST(o_orderkey AS VARCHAR)
          AS relname, o_custkey % 25 AS ns, lower(o_orderstatus) AS relkind,
          o_orderkey * 3 AS relpages, CASE WHEN o_orderkey % 7 = 0 THEN -1
          ELSE CAST(floor(o_totalprice) AS BIGINT) END AS reltuples, o_orderkey % 3 AS relam
        FROM orders),
nsp AS (SELECT n_nationkey AS oid, CASE WHEN n_nationkey = 0 THEN 'public' ELSE lower(n_name) END
          AS nspname FROM nation)
"""
_REQUESTED = """
req AS (SELECT l_orderkey % 5 AS db_id, l_orderkey AS oid, l_orderkey % 25 AS q,
               CASE WHEN l_partkey % 2 = 0 THEN 'r' || CAST(l_orderkey AS VARCHAR) ELSE
               lower(n_name) || '.r' || CAST(l_orderkey AS VARCHAR) END AS requested,
               CASE WHEN l_partkey % 2 = 0 THEN 'public' ELSE lower(n_name) END AS want_ns
        FROM lineitem JOIN nation ON n_nationkey = l_suppkey % 25),
reqd AS (SELECT DISTINCT db_id, oid, requested, want_ns FROM req)
"""


def requested(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation").select(
        (F.col("n_nationkey")).cast("bigint").alias("nk"), F.lower("n_name").alias("ns"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", (
        F.col("l_suppkey") % 25).alias("nk"))
    name = F.concat(F.lit("r"), text(F.col("l_orderkey")))
    return li.join(F.broadcast(n), "nk").select(
        (F.col("l_orderkey") % 5).alias("db_id"), F.when(F.col("l_partkey") % 2 == 0, name)
        .otherwise(F.concat("ns", F.lit("."), name)).alias("requested")).distinct()


def resolved(spark, sf) -> DataFrame:
    return cg.resolve_relations(requested(spark, sf), pg_class(spark, sf),
                                pg_namespace(spark, sf))


@query("catalog_probes", cte(CORPUS, UNITS) + f"""
, p AS (
  SELECT db_id, 'relation' AS probe, unnest(list_filter([rel, CASE WHEN two_targets THEN other END,
         refs, parent, CASE WHEN is_action THEN other END], lambda x: x IS NOT NULL)) AS relation,
         NULL AS name, NULL AS type FROM units
  UNION ALL
  SELECT db_id, 'type', NULL, NULL, 'int' FROM units WHERE is_action AND ukind LIKE 'add_column%'
  UNION ALL
  SELECT db_id, 'type_change', rel, 'c' || CAST(idx % 5 AS VARCHAR), 'int' FROM units
  WHERE ukind = 'alter_column_type')
SELECT DISTINCT db_id, probe, relation, name, type FROM p""")
def catalog_probes(spark, sf):
    return cg.probes(explode_units(adapters.statements(spark, sf)))


@query("relation_resolution", cte(_CLASS, _REQUESTED) + """
SELECT r.db_id, r.requested, c.oid IS NOT NULL AS found, coalesce(c.relpages, -1) AS relpages,
       CASE WHEN c.oid IS NULL OR c.reltuples < 0 THEN -1 ELSE c.reltuples END AS reltuples,
       coalesce(c.relkind, '') AS relkind
FROM reqd r LEFT JOIN (SELECT cls.*, nspname FROM cls JOIN nsp ON nsp.oid = cls.ns) c
  ON c.db_id = r.db_id AND c.nspname = r.want_ns AND c.oid = r.oid""")
def relation_resolution(spark, sf):
    return resolved(spark, sf).select(
        "db_id", "requested", F.col("exists").alias("found"), value("relpages"),
        value("reltuples"), F.coalesce("relkind", F.lit("")).alias("relkind"))


# Relations with plain, mixed-case, dotted and quoted names, each in two schemas of like kinds.
_NAMES = """
nsp AS (SELECT CAST(n_nationkey AS BIGINT) AS ns, CASE n_nationkey % 3 WHEN 0 THEN lower(n_name)
          WHEN 1 THEN n_name ELSE lower(n_name) || '.x' END AS nspname FROM nation),
cls AS (SELECT o_orderkey % 5 AS db_id, o_orderkey AS k, o_orderkey * 2 + side AS oid,
               (o_custkey + side) % 25 AS ns, concat(CASE o_orderkey % 4 WHEN 0 THEN 'r'
               WHEN 1 THEN 'Rel.' WHEN 2 THEN 'q"' ELSE 'T' END, CAST(o_orderkey AS STRING)) AS relname
        FROM orders CROSS JOIN (SELECT 0 AS side UNION ALL SELECT 1) sides),
path AS (SELECT ns, nspname, ns * 7 % 25 AS place FROM nsp WHERE ns % 2 = 1),
asks AS (SELECT DISTINCT db_id, k, relname, cls.ns, nspname, manner FROM cls JOIN nsp USING (ns)
         CROSS JOIN (SELECT 0 AS manner UNION ALL SELECT 1 UNION ALL SELECT 2) manners)
"""
_SPELLED = """CASE manner
  WHEN 0 THEN concat('"', replace(nspname, '"', '""'), '"."', replace(relname, '"', '""'), '"')
  WHEN 1 THEN concat('"', replace(relname, '"', '""'), '"')
  ELSE CASE k % 4 WHEN 2 THEN concat('"q""', CAST(k AS STRING), '"') ELSE upper(relname) END END"""


@query("spelled_names", cte(_NAMES).replace("STRING", "VARCHAR") + f"""
, spelled AS (SELECT DISTINCT db_id, k, {_SPELLED.replace("STRING", "VARCHAR")} AS requested, manner,
                     CASE WHEN manner = 0 THEN nspname END AS want_ns, relname FROM asks),
hits AS (SELECT s.*, c.oid, n.nspname, p.place FROM spelled s
  LEFT JOIN cls c ON c.db_id = s.db_id AND c.k = s.k AND (manner < 2 OR s.k % 4 IN (0, 2))
  LEFT JOIN nsp n ON n.ns = c.ns LEFT JOIN path p ON p.ns = c.ns),
kept AS (SELECT *, row_number() OVER (PARTITION BY db_id, requested
           ORDER BY CASE WHEN want_ns IS NOT NULL THEN nspname <> want_ns ELSE place IS NULL END,
                    place, oid) AS nth,
           coalesce(CASE WHEN want_ns IS NOT NULL THEN nspname = want_ns ELSE place IS NOT NULL END,
                    false) AS found FROM hits)
SELECT db_id, requested, found, CASE WHEN found THEN oid ELSE -1 END AS oid,
       CASE WHEN found THEN nspname ELSE '' END AS schema FROM kept WHERE nth = 1""")
def spelled_names(spark, sf):
    for name in ("orders", "nation"):
        table(spark, sf, name).createOrReplaceTempView(f"spelled_{name}")
    named = _NAMES.replace("FROM orders", "FROM spelled_orders").replace(
        "FROM nation", "FROM spelled_nation")
    take = lambda sql: spark.sql(cte(named) + sql)
    asked = take(f"SELECT DISTINCT db_id, {_SPELLED} AS requested FROM asks")
    spaces = take("SELECT db_id, ns AS oid, nspname FROM nsp CROSS JOIN (SELECT explode(sequence("
                  "0L, 4L)) AS db_id) dbs")
    path = take("SELECT db_id, nspname, place FROM path CROSS JOIN (SELECT explode(sequence(0L, 4L))"
                " AS db_id) dbs")
    classes = take("SELECT db_id, oid, relname, ns AS relnamespace, 'r' AS relkind, 1L AS relpages,"
                   " 1L AS reltuples FROM cls")
    return cg.resolve_relations(asked, classes, spaces, path).select(
        "db_id", "requested", F.col("exists").alias("found"),
        F.coalesce("oid", F.lit(-1)).alias("oid"), F.coalesce("nspname", F.lit("")).alias("schema"))


def pg_stat(spark, sf) -> DataFrame:
    c = F.col("o_orderkey")
    return table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(
        (c % 5).alias("db_id"), c.alias("relid"),
        F.when(c % 4 != 0, F.col("o_orderdate").cast("timestamp")).alias("last_analyze"),
        F.lit(None).cast("timestamp").alias("last_autoanalyze"),
        (c % 100).alias("n_mod_since_analyze"))


@query("statistics_facts", cte(_CLASS, _REQUESTED) + """
SELECT r.db_id, r.requested, o.o_orderkey IS NOT NULL AS has_row,
       o.o_orderkey IS NOT NULL AND o.o_orderkey % 4 <> 0 AS analyzed,
       coalesce(o.o_orderkey % 100, -1) AS n_mod
FROM reqd r LEFT JOIN (SELECT cls.*, nspname FROM cls JOIN nsp ON nsp.oid = cls.ns) c
  ON c.db_id = r.db_id AND c.nspname = r.want_ns AND c.oid = r.oid
LEFT JOIN orders o ON o.o_orderkey = c.oid AND o.o_orderstatus <> 'P'""")
def statistics_facts(spark, sf):
    return cg.statistics_facts(resolved(spark, sf), pg_stat(spark, sf)).select(
        "db_id", "requested", F.col("last_analyze.available").alias("has_row"),
        (F.col("last_analyze.available") & F.col("last_analyze.value").isNotNull()
         ).alias("analyzed"), value("n_mod"))


@query("partition_totals", """
WITH RECURSIVE e AS (SELECT c_custkey AS child, c_custkey // 4 AS parent,
                            CAST(floor(c_acctbal) AS BIGINT) AS size FROM customer
                     WHERE c_custkey > 0),
walk AS (SELECT c_custkey AS root, c_custkey AS node, 0 AS depth FROM customer
         UNION ALL SELECT w.root, e.child, w.depth + 1 FROM walk w JOIN e ON e.parent = w.node)
SELECT w.root, count(e.child) AS partitions, CAST(coalesce(sum(e.size), 0) AS BIGINT) AS total_bytes
FROM walk w LEFT JOIN e ON e.child = w.node AND w.depth > 0 GROUP BY w.root""")
def partition_totals(spark, sf):
    c = table(spark, sf, "customer")
    key, one = F.col("c_custkey"), F.lit(1).alias("db_id")
    inherits = c.filter("c_custkey > 0").select(
        one, key.alias("inhrelid"), (key / 4).cast("bigint").alias("inhparent"))
    sizes = c.select(one, key.alias("oid"), F.floor("c_acctbal").cast("bigint").alias(
        "total_bytes"))
    roots = c.select(one, key.alias("oid"))
    return cg.partition_totals(roots, inherits, sizes).drop("db_id")


def pg_attribute(spark, sf) -> DataFrame:
    """One column per (order, line number)."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"),
        F.max("l_returnflag").alias("flag"))
    return li.select(
        (F.col("l_orderkey") % 5).alias("db_id"), F.col("l_orderkey").alias("attrelid"),
        F.col("l_linenumber").cast("bigint").alias("attnum"),
        F.concat(F.lit("c"), text(F.col("l_linenumber"))).alias("attname"),
        (F.col("p") % 20).alias("atttypid"), (F.col("s") % 3 == 0).alias("attnotnull"),
        (F.col("flag") == "A").alias("attisdropped"), F.lit("").alias("attidentity"),
        F.when(F.col("flag") == "R", "s").otherwise("").alias("attgenerated"))


_ATTRIBUTE = """
att AS (SELECT l_orderkey AS rel, l_orderkey % 5 AS db_id, l_linenumber AS num,
               'c' || CAST(l_linenumber AS VARCHAR) AS name, min(l_partkey) % 20 AS typ,
               min(l_suppkey) % 3 = 0 AS nn, max(l_returnflag) AS flag
        FROM lineitem GROUP BY l_orderkey, l_linenumber)
"""


def pg_index(spark, sf) -> DataFrame:
    """One index per order that has line items; it lists two key columns."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        (k % 5).alias("db_id"), (k + 1_000_000_000).alias("indexrelid"), k.alias("indrelid"),
        F.array(k % 7 + 1, k % 3).alias("indkey"), F.array(k % 4, k % 6).alias("indclass"),
        (k % 9 != 0).alias("indisvalid"), F.when(k % 5 == 0, "x > 0").alias("indpred"),
        F.when(k % 8 == 0, "lower(x)").alias("indexprs"))


def index_facts_frame(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    classes = table(spark, sf, "orders").select(
        (k % 5).alias("db_id"), (k + 1_000_000_000).alias("oid"),
        F.concat(F.lit("i"), text(k)).alias("relname"), (k % 3).alias("relam"))
    depend = table(spark, sf, "orders").filter("o_orderkey % 8 = 0").select(
        (k % 5).alias("db_id"), (k + 1_000_000_000).alias("objid"), k.alias("refobjid"),
        F.lit(4).cast("bigint").alias("refobjsubid"))
    small = table(spark, sf, "nation").select(
        F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(5)])).alias("db_id"),
        F.col("n_nationkey").cast("bigint").alias("oid"))
    am = small.filter("oid < 3").withColumn("amname", pick(["btree", "gin", "hash"], F.col("oid")))
    opclass = small.filter("oid < 6").withColumn("opcdefault", F.col("oid") != 5)
    return cg.index_facts(pg_index(spark, sf), classes, am, opclass, depend,
                          pg_attribute(spark, sf))


_INDEX = _ATTRIBUTE + """,
ix AS (SELECT o_orderkey AS k, o_orderkey % 5 AS db_id FROM orders),
kc AS (SELECT k, unnest([k % 7 + 1, k % 3]) AS num FROM ix
       UNION SELECT k, 4 FROM ix WHERE k % 8 = 0),
dep AS (SELECT kc.k, string_agg(DISTINCT a.name, ',' ORDER BY a.name) AS cols
        FROM kc JOIN att a ON a.rel = kc.k AND a.num = kc.num WHERE kc.num > 0 GROUP BY kc.k)
"""


@query("index_facts", cte(_INDEX) + """
SELECT ix.db_id, 'i' || CAST(ix.k AS VARCHAR) AS name, (['btree', 'gin', 'hash'])[ix.k % 3 + 1]
         AS method, ix.k % 9 <> 0 AS valid, ix.k % 5 = 0 AS partial, ix.k % 8 = 0 AS has_expressions,
       ix.k % 6 <> 5 AS default_opclasses, coalesce(cols, '') AS depends_on
FROM ix LEFT JOIN dep ON dep.k = ix.k""")
def index_facts(spark, sf):
    return index_facts_frame(spark, sf).select(
        "db_id", "name", "method", "valid", "partial", "has_expressions", "default_opclasses",
        F.array_join("depends_on", ",").alias("depends_on"))


@query("index_sizes", cte(_INDEX) + """
SELECT db_id, k AS relation, 1 AS indexes, CASE WHEN k % 9 = 0 THEN 'i' || CAST(k AS VARCHAR)
  ELSE '' END AS invalid, CASE WHEN k % 10 = 0 THEN 0 ELSE k * 8 END AS index_bytes,
  CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS unsized FROM ix""")
def index_sizes(spark, sf):
    k = F.col("o_orderkey")
    sizes = table(spark, sf, "orders").filter("o_orderkey % 10 <> 0").select(
        (k % 5).alias("db_id"), (k + 1_000_000_000).alias("oid"), (k * 8).alias("rel_bytes"))
    return cg.index_sizes(index_facts_frame(spark, sf), sizes).select(
        "db_id", F.col("indrelid").alias("relation"), "indexes",
        F.array_join("invalid", ",").alias("invalid"), "index_bytes", "unsized")


def pg_type(spark, sf) -> DataFrame:
    """Types in chains: every third one is a domain over a smaller type."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    domain = (k % 3 == 0) & (k > 0)
    return p.select(
        F.lit(1).cast("bigint").alias("db_id"), k.alias("oid"),
        F.concat(F.lit("type"), text(k)).alias("typname"),
        F.when(domain, "d").otherwise("b").alias("typtype"),
        F.when(domain, (k / 3).cast("bigint")).otherwise(0).alias("typbasetype"),
        (domain & (F.col("p_size") % 4 == 0)).alias("typnotnull"),
        F.when(domain & (F.col("p_size") % 5 == 0), 8).otherwise(-1).alias("typtypmod"))


def type_checks(spark, sf) -> DataFrame:
    s = table(spark, sf, "lineitem").select(
        F.lit(1).cast("bigint").alias("db_id"),
        F.when(F.col("l_linenumber") < 4, "c").otherwise("n").alias("contype"),
        F.when(F.col("l_suppkey") % 2 == 0, F.col("l_partkey")).alias("contypid"))
    return s


@query("column_facts", cte(_ATTRIBUTE) + """
, chk AS (SELECT l_partkey AS typ, count(*) AS n FROM lineitem
          WHERE l_suppkey % 2 = 0 AND l_linenumber < 4 GROUP BY 1)
SELECT rel AS relation, num AS attnum, name, 'type' || CAST(a.typ AS VARCHAR) AS data_type, nn AS not_null,
       rel % 6 = 0 AS has_default, a.typ % 3 = 0 AND a.typ > 0 AS is_domain,
       a.typ % 3 = 0 AND a.typ > 0 AND p_size % 4 = 0 AS domain_not_null,
       CASE WHEN a.typ % 3 = 0 AND a.typ > 0 THEN coalesce(n, 0) ELSE 0 END AS domain_checks
FROM att a JOIN part ON p_partkey = a.typ LEFT JOIN chk ON chk.typ = a.typ
WHERE flag <> 'A'""")
def column_facts(spark, sf):
    # the exported types belong to one database here, so they are given to all
    def everywhere(df):
        return df.drop("db_id").withColumn("db_id", F.explode(F.array(
            *[F.lit(i).cast("bigint") for i in range(5)])))

    attributes = pg_attribute(spark, sf)
    defaults = attributes.filter("attrelid % 6 = 0").select(
        "db_id", F.col("attrelid").alias("adrelid"), F.col("attnum").alias("adnum"),
        F.lit("0").alias("adbin"))
    return cg.column_facts(attributes, everywhere(pg_type(spark, sf)), defaults,
                           everywhere(type_checks(spark, sf))).select(
        F.col("attrelid").alias("relation"), "attnum", F.col("attname").alias("name"),
        "data_type", "not_null", F.col("default_expression").isNotNull().alias("has_default"),
        "is_domain", "domain_not_null", "domain_checks")


@query("dropped_columns", cte(_ATTRIBUTE) + """
SELECT rel AS relation, count(*) FILTER (WHERE flag = 'A') AS dropped FROM att GROUP BY rel""")
def dropped_columns(spark, sf):
    return cg.dropped_columns(pg_attribute(spark, sf)).select(
        F.col("attrelid").alias("relation"), "dropped")


@query("constraint_facts", cte(_ATTRIBUTE, _CLASS) + """
, kc AS (SELECT o_orderkey AS k, unnest([o_orderkey % 7 + 1, o_orderkey % 5 + 1]) AS num,
                generate_subscripts([1, 2], 1) AS place FROM orders),
cols AS (SELECT kc.k, string_agg(a.name, ',' ORDER BY place) AS cols
         FROM kc JOIN att a ON a.rel = kc.k AND a.num = kc.num GROUP BY 1)
SELECT o_orderkey AS relation, (['c', 'f', 'u'])[o_orderkey % 3 + 1] AS contype,
       o_orderkey % 4 <> 0 AS validated, coalesce(cols, '') AS columns_,
       CASE WHEN o_orderkey % 3 = 0 THEN 'x > 0' END AS check_expression, t.name AS referenced_table
FROM orders LEFT JOIN cols ON cols.k = o_orderkey
LEFT JOIN (SELECT cls.db_id, cls.oid, nspname || '.' || relname AS name
           FROM cls JOIN nsp ON nsp.oid = cls.ns) t
  ON o_orderkey % 3 = 1 AND t.oid = o_orderkey - 5 AND t.db_id = o_orderkey % 5""")
def constraint_facts(spark, sf):
    k = F.col("o_orderkey")
    con = table(spark, sf, "orders").select(
        (k % 5).alias("db_id"), (k + 2_000_000_000).alias("oid"), k.alias("conrelid"),
        F.concat(F.lit("k"), text(k)).alias("conname"), pick(["c", "f", "u"], k % 3).alias(
            "contype"), (k % 4 != 0).alias("convalidated"),
        F.array(k % 7 + 1, k % 5 + 1).alias("conkey"), F.lit("x > 0").alias("conbin"),
        F.when(k % 3 == 1, k - 5).alias("confrelid"))
    return cg.constraint_facts(con, pg_attribute(spark, sf), pg_class(spark, sf),
                               pg_namespace(spark, sf)).select(
        F.col("conrelid").alias("relation"), "contype", "validated",
        F.array_join("columns", ",").alias("columns_"), "check_expression", "referenced_table")


@query("function_facts", """
WITH proc AS (SELECT p_brand AS name, p_size % 25 AS ns, (['i','s','v'])[p_partkey % 3 + 1] AS vol,
                     CASE WHEN p_size > 48 THEN 'p' ELSE 'f' END AS kind FROM part),
req AS (SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 'nation_' || CAST(l_suppkey % 25 AS VARCHAR)
          || '.' ELSE '' END || '"Brand#' || CAST(l_partkey % 40 AS VARCHAR) || '"' AS function,
          CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey % 25 END AS ns,
          'Brand#' || CAST(l_partkey % 40 AS VARCHAR) AS name FROM lineitem)
SELECT function, count(p.name) AS overloads, count(p.name) > 0 AS found,
       coalesce(CASE WHEN min(vol) = max(vol) THEN min(vol) END, 'unavailable') AS volatility,
       coalesce(CASE WHEN min(kind) = max(kind) THEN min(kind) END, 'unavailable') AS prokind
FROM req r LEFT JOIN proc p ON p.name = r.name AND (r.ns IS NULL OR r.ns = p.ns)
GROUP BY function""")
def function_facts(spark, sf):
    one = F.lit(1).cast("bigint").alias("db_id")
    procs = table(spark, sf, "part").select(
        one, F.col("p_brand").alias("proname"), (F.col("p_size") % 25).cast("bigint").alias(
            "pronamespace"), pick(["i", "s", "v"], F.col("p_partkey") % 3).alias("provolatile"),
        F.when(F.col("p_size") > 48, "p").otherwise("f").alias("prokind"))
    spaces = table(spark, sf, "nation").select(
        one, F.col("n_nationkey").cast("bigint").alias("oid"), F.lower("n_name").alias("nspname"))
    schema = F.when(F.col("l_linenumber") % 2 == 0, F.concat(
        F.lit("nation_"), text(F.col("l_suppkey") % 25), F.lit("."))).otherwise("")
    asked = table(spark, sf, "lineitem").select(one, F.concat(
        schema, F.lit('"Brand#'), text(F.col("l_partkey") % 40), F.lit('"')).alias("function")
    ).distinct()
    return cg.function_facts(asked, procs, spaces).select(
        "function", "overloads", F.col("exists").alias("found"),
        F.coalesce("volatility", F.lit("unavailable")).alias("volatility"),
        F.coalesce("prokind", F.lit("unavailable")).alias("prokind"))


_CHAINS = """
WITH RECURSIVE t AS (SELECT p_partkey AS oid, p_partkey % 3 = 0 AND p_partkey > 0 AS dom,
    p_partkey // 3 AS base, p_partkey % 3 = 0 AND p_partkey > 0 AND p_size % 4 = 0 AS nn,
    p_partkey % 3 = 0 AND p_partkey > 0 AND p_size % 5 = 0 AS typmod FROM part),
chk AS (SELECT l_partkey AS oid, count(*) AS n FROM lineitem
        WHERE l_suppkey % 2 = 0 AND l_linenumber < 4 GROUP BY 1),
chain AS (SELECT oid AS root, oid AS node, 0 AS depth FROM t
  UNION ALL SELECT c.root, t.base, c.depth + 1 FROM chain c JOIN t ON t.oid = c.node WHERE t.dom),
facts AS (SELECT root AS type_oid, bool_or(depth = 0 AND t.dom) AS is_domain,
    max_by(node, depth) AS base_oid, bool_or(nn) AS not_null,
    CAST(coalesce(sum(n), 0) AS BIGINT) AS checks, bool_or(typmod) AS has_typmod,
    max(depth) AS depth
  FROM chain c JOIN t ON t.oid = c.node LEFT JOIN chk ON chk.oid = c.node GROUP BY root)
"""


@query("type_facts", _CHAINS + "SELECT * FROM facts")
def type_facts(spark, sf):
    types = pg_type(spark, sf)
    starts = types.select("db_id", F.col("oid").alias("type_oid"))
    return cg.type_facts(starts, types, type_checks(spark, sf)).drop("db_id")


@query("type_change_facts", _CHAINS + """
, casts AS (SELECT s_suppkey * 3 % 20 AS a, s_suppkey % 20 AS b, min((['b','f','i'])[s_suppkey % 3 + 1])
            AS method FROM supplier GROUP BY 1, 2),
req AS (SELECT p_partkey AS request_id, p_partkey AS cur, p_partkey * 7 % 200 AS new_ FROM part)
SELECT request_id, c.base_oid AS cur_base, coalesce(n.base_oid, -1) AS new_base,
       cur = new_ AS same_type, coalesce(c.base_oid = n.base_oid, false) AS bases_same,
       coalesce(method, 'none') AS cast_method
FROM req JOIN facts c ON c.type_oid = cur LEFT JOIN facts n ON n.type_oid = new_
LEFT JOIN casts ON casts.a = c.base_oid AND casts.b = n.base_oid""")
def type_change_facts(spark, sf):
    types, one = pg_type(spark, sf), F.lit(1).cast("bigint").alias("db_id")
    key = F.col("s_suppkey")
    casts = table(spark, sf, "supplier").select(
        one, (key * 3 % 20).alias("castsource"), (key % 20).alias("casttarget"),
        pick(["b", "f", "i"], key % 3).alias("castmethod")).groupBy(
        "db_id", "castsource", "casttarget").agg(F.min("castmethod").alias("castmethod"))
    asked = table(spark, sf, "part").select(
        one, F.col("p_partkey").alias("request_id"), F.col("p_partkey").alias("cur_oid"),
        (F.col("p_partkey") * 7 % 200).alias("new_oid"))
    return cg.type_change_facts(asked, types, type_checks(spark, sf), casts).select(
        "request_id", F.col("cur_base_oid").alias("cur_base"),
        F.coalesce("new_base_oid", F.lit(-1)).alias("new_base"), "same_type",
        F.coalesce("bases_same", F.lit(False)).alias("bases_same"),
        F.coalesce("cast_method", F.lit("none")).alias("cast_method"))


MODES = adapters.WAIT_MODES[:8]


def lock_table(spark, sf) -> DataFrame:
    """Locks from events; every fifth one waits for two other backends."""
    i, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf, "events").select(
        (u % 5).alias("db_id"), (i % 50).alias("relation"), i.alias("pid"),
        pick(MODES, (i + u) % 8).alias("mode"), (i % 5 != 0).alias("granted"),
        F.when(i % 5 == 0, F.when(i % 35 == 0, F.array().cast("array<bigint>")).otherwise(
            F.array(i + 50, i + 100))).alias("blocking_pids"))


STATES = ["active", "idle in transaction", "idle in transaction (aborted)", None]


def activity(spark, sf) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf, "events").select(
        (F.col("user_id") % 5).alias("db_id"), i.alias("pid"),
        pick(STATES, i % 4).alias("state"), F.floor(F.col("value") * 100).cast("bigint").alias(
            "xact_age_ms"),
        pick(["  UPDATE t SET a = 1", "<insufficient privilege>", "", "select 1"], i % 4).alias(
            "query"),
        F.when(i % 3 == 0, "Lock").alias("wait_event_type"),
        F.when(i % 6 == 0, "walsender").otherwise("client backend").alias("backend_type"))


@query("lock_waiters", f"""
WITH l AS (SELECT user_id % 5 AS db_id, event_id % 50 AS relation, event_id AS pid,
    {pick_sql(MODES, "(event_id + user_id) % 8")} AS mode, event_id % 5 <> 0 AS granted,
    event_id % 17 = 0 AS own FROM events),
w AS (SELECT db_id, relation, pid AS blocked, mode,
             unnest(CASE WHEN pid % 35 = 0 THEN [NULL::BIGINT] ELSE [pid + 50, pid + 100] END) AS b
      FROM l WHERE NOT granted AND NOT own),
x AS (SELECT w.*, CASE WHEN o.pid IS NULL THEN b END AS blocker FROM w
      LEFT JOIN l o ON o.db_id = w.db_id AND o.pid = w.b AND o.own),
y AS (SELECT x.*, h.mode AS held, CASE WHEN a.db_id IS NULL THEN NULL
             ELSE {pick_sql(STATES, "blocker % 4")} END AS state
      FROM x LEFT JOIN l h ON h.db_id = x.db_id AND h.relation = x.relation AND h.pid = x.blocker
                           AND h.granted AND NOT h.own
             LEFT JOIN l a ON a.db_id = x.db_id AND a.pid = x.blocker)
SELECT db_id, relation, blocked AS blocked_pid, mode AS blocked_mode, count(blocker) AS blockers,
  coalesce(string_agg(DISTINCT held, ',' ORDER BY held), '') AS blocking_modes,
  CASE WHEN count(blocker) = 0 OR count(blocker) <> count(state) THEN 'unavailable'
       WHEN bool_and(blocker IS NULL OR state LIKE 'idle in transaction%') THEN 'idle' ELSE 'active'
  END AS holders FROM y GROUP BY 1, 2, 3, 4""")
def lock_waiters(spark, sf):
    own = table(spark, sf, "events").filter("event_id % 17 = 0").select(
        (F.col("user_id") % 5).alias("db_id"), F.col("event_id").alias("pid"))
    found = cg.lock_waiters(lock_table(spark, sf), activity(spark, sf), own)
    return found.select(
        "db_id", "relation", "blocked_pid", "blocked_mode", "blockers",
        F.coalesce(F.array_join("blocking_modes", ","), F.lit("")).alias("blocking_modes"),
        F.when(F.col("all_idle").isNull(), "unavailable").when(F.col("all_idle"), "idle")
        .otherwise("active").alias("holders"))


@query("long_transactions", """
WITH a AS (SELECT user_id % 5 AS db_id, event_id AS pid, CAST(floor(value * 100) AS BIGINT) AS age,
                  event_id % 4 AS s, event_id % 3 = 0 AS lock FROM events)
SELECT db_id, row_number() OVER (PARTITION BY db_id ORDER BY age DESC, pid) AS place, pid,
  (['active', 'idle in transaction', 'idle in transaction (aborted)', 'unknown'])[s + 1] AS state,
  s IN (1, 2) AS idle, age AS xact_age_ms,
  CASE s WHEN 0 THEN 'update' WHEN 3 THEN 'select' END AS first_keyword, lock AS waiting_on_lock
FROM a WHERE age >= 5000
QUALIFY row_number() OVER (PARTITION BY db_id ORDER BY age DESC, pid) <= 20""")
def long_transactions(spark, sf):
    return cg.long_transactions(activity(spark, sf), 5000, 20)


def server_table(spark, sf) -> DataFrame:
    return table(spark, sf, "region").select(
        F.col("r_regionkey").cast("bigint").alias("db_id"),
        (F.col("r_regionkey") != 3).alias("can_read_stats"),
        (F.col("r_regionkey") == 1).alias("in_recovery"), F.lit(100).alias("max_connections"))


@query("connection_counts", """
SELECT r_regionkey AS db_id, CASE WHEN r_regionkey = 3 THEN -1 ELSE (SELECT count(*) FROM events
  WHERE user_id % 5 = r_regionkey AND event_id % 6 <> 0) END AS connections,
  100 AS max_connections FROM region""")
def connection_counts(spark, sf):
    return cg.connection_counts(activity(spark, sf), server_table(spark, sf)).select(
        F.col("db_id").cast("int").alias("db_id"), value("connections"), "max_connections")


@query("replication_facts", """
WITH r AS (SELECT s_suppkey % 4 AS db_id, CASE WHEN s_nationkey = 7 AND s_suppkey % 4 = 2 THEN NULL
             ELSE CAST(floor(s_acctbal) AS BIGINT) END AS bytes, s_suppkey AS ms FROM supplier)
SELECT r_regionkey AS db_id, count(r.ms) > 0 AS has_replicas, count(r.ms) AS replicas,
  CASE WHEN r_regionkey IN (1, 3, 4) OR count(r.ms) FILTER (WHERE bytes IS NULL) > 0
       OR count(r.ms) = 0 THEN -1 ELSE max(bytes) END AS lag_bytes,
  CASE WHEN r_regionkey IN (3, 4) OR count(r.ms) = 0 THEN -1 ELSE max(ms) END AS lag_ms
FROM region LEFT JOIN r ON r.db_id = r_regionkey GROUP BY r_regionkey""")
def replication_facts(spark, sf):
    k = F.col("s_suppkey")
    replicas = table(spark, sf, "supplier").select(
        (k % 4).alias("db_id"),
        F.when(~((F.col("s_nationkey") == 7) & (k % 4 == 2)), F.floor("s_acctbal").cast(
            "bigint")).alias("replay_lag_bytes"), k.alias("replay_lag_ms"))
    return cg.replication_facts(server_table(spark, sf), replicas).select(
        F.col("db_id").cast("int").alias("db_id"), "has_replicas", "replicas",
        value("lag_bytes"), value("lag_ms"))


SETTINGS = ["server_version_num", "lock_timeout", "statement_timeout", "TimeZone"]


@query("server_facts", """
SELECT c_custkey // 4 AS db_id, CAST(max(CASE WHEN c_custkey % 4 = 0 THEN 10 + c_nationkey % 9 END) AS INT)
  AS pg_version, max(CASE WHEN c_custkey % 4 = 0 THEN c_nationkey % 9 END) >= 4 AS has_wait_start,
  coalesce(max(CASE WHEN c_custkey % 4 = 1 THEN CASE WHEN c_nationkey % 5 = 0 THEN -1
           ELSE c_custkey * 10 END END), -1) AS lock_timeout_ms,
  coalesce(max(CASE WHEN c_custkey % 4 = 2 THEN CASE WHEN c_nationkey % 5 = 0 THEN -1
           ELSE c_custkey * 10 END END), -1) AS statement_timeout_ms,
  max(CASE WHEN c_custkey % 4 = 3 THEN c_mktsegment END) AS time_zone
FROM customer GROUP BY 1""")
def server_facts(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    settings = table(spark, sf, "customer").select(
        (k / 4).cast("bigint").alias("db_id"), pick(SETTINGS, k % 4).alias("name"),
        F.when(k % 4 == 0, text((n % 9 + 10) * 10000 + 3)).when(
            k % 4 == 3, F.col("c_mktsegment")).otherwise(text(k * 10)).alias("reset_val"),
        F.when(n % 5 == 0, "s").when(n % 5 == 1, None).otherwise("ms").alias("unit"))
    return cg.server_facts(settings).select(
        "db_id", "pg_version", "has_wait_start", value("lock_timeout_ms"),
        value("statement_timeout_ms"), "time_zone")


@query("probe_calibration", """
SELECT user_id AS db_id, min(100 + event_id % 700) AS compute_ms FROM events GROUP BY user_id""")
def probe_calibration(spark, sf):
    readings = table(spark, sf, "events").select(
        F.col("user_id").alias("db_id"), (F.col("event_id") % 700 + 100).alias("compute_ms"))
    return cg.calibration(readings)


@query("schema_differences", """
WITH l AS (SELECT p_brand AS a, NULLIF(CAST(floor(p_retailprice) AS BIGINT), 1000) AS b FROM part
           WHERE p_size <= 25),
r AS (SELECT p_brand AS a, NULLIF(CAST(floor(p_retailprice) AS BIGINT), 1000) AS b FROM part
      WHERE p_size > 25 OR p_size IS NULL),
c AS (SELECT a, b, sum(x) AS l, sum(y) AS r FROM (SELECT a, b, 1 AS x, 0 AS y FROM l
      UNION ALL SELECT a, b, 0, 1 FROM r) GROUP BY a, b)
SELECT a AS relation, coalesce(b, -1) AS attribute, CASE WHEN r = 0 THEN 'left' ELSE 'right' END AS only,
       CAST(greatest(l, r) AS BIGINT) AS copies FROM c WHERE l = 0 OR r = 0""")
def schema_differences(spark, sf):
    part = table(spark, sf, "part").selectExpr(
        "p_brand AS relation", "nullif(floor(p_retailprice), 1000) AS attribute",
        "coalesce(p_size <= 25, false) AS is_left")
    out = cg.schema_differences(part.filter("is_left"), part.filter("NOT is_left"),
                                ["relation", "attribute"])
    return out.withColumn("attribute", F.coalesce("attribute", F.lit(-1)))


@query("nested_relation_facts", cte(_CLASS) + """
, n AS (SELECT l_orderkey AS rel, count(DISTINCT l_linenumber) AS all_ FROM lineitem GROUP BY 1),
live AS (SELECT l_orderkey AS rel, count(*) AS live FROM
         (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2)
         WHERE f <> 'A' GROUP BY 1)
SELECT db_id, nspname || '.' || relname AS relation, coalesce(live.live, 0) AS columns_,
       1 AS indexes FROM cls JOIN nsp ON nsp.oid = cls.ns LEFT JOIN live ON live.rel = cls.oid""")
def nested_relation_facts(spark, sf):
    classes, spaces = pg_class(spark, sf), pg_namespace(spark, sf)
    named = classes.join(F.broadcast(spaces.select(
        "db_id", F.col("oid").alias("relnamespace"), "nspname")), ["db_id", "relnamespace"])
    asked = named.select("db_id", F.concat_ws(".", "nspname", "relname").alias("requested"))
    found = cg.statistics_facts(cg.resolve_relations(asked, classes, spaces), pg_stat(spark, sf))
    attributes = pg_attribute(spark, sf)

    def everywhere(df):
        return df.drop("db_id").withColumn("db_id", F.explode(F.array(
            *[F.lit(i).cast("bigint") for i in range(5)])))

    none = attributes.limit(0).select("db_id", F.col("attrelid").alias("adrelid"),
                                      F.col("attnum").alias("adnum"), F.lit("").alias("adbin"))
    columns = cg.column_facts(attributes, everywhere(pg_type(spark, sf)), none,
                              everywhere(type_checks(spark, sf)))
    constraints = spark.createDataFrame(
        [], "db_id bigint, conrelid bigint, name string, contype string, validated boolean, "
        "columns array<string>, check_expression string, referenced_table string")
    sizes = classes.select("db_id", "oid", (F.col("relpages") * 8192).alias("rel_bytes"))
    nested = cg.nest_relation_facts(found, index_facts_frame(spark, sf), columns, constraints,
                                    sizes)
    return nested.select("db_id", "relation",
                         F.size("facts.columns.value").cast("bigint").alias("columns_"),
                         F.size("facts.indexes.value").alias("indexes"))


