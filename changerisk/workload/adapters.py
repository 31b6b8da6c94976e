"""Shapes the operators need, derived from the given tables.

Every adapter exists twice: as a DataFrame for Spark and as CTE text for the
SQL check. Both read whole tables; a row of the source is a row of the shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changerisk.functions.binding import record
from changerisk.functions.facts import known, unavailable
from changerisk.seeds import tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(names: list[str], position: Column) -> Column:
    """The entry of a constant list at a position."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (position + 1).cast("int"))


def pick_sql(names: list[str], position: str) -> str:
    items = ", ".join("NULL" if n is None else f"'{n}'" for n in names)
    return f"([{items}])[({position}) + 1]"


# What a statement of the event log does; repeated entries make a form common.
STATEMENT_MIX = """create_table create_index alter_table insert begin update_without_where
alter_table drop_table commit alter_table create_index_concurrently update truncate rename_table
create_table_as select alter_table vacuum drop_index comment_on delete alter_table lock_table
begin create_view alter_enum_add_value update_batched rollback reindex copy_from drop_view
alter_table delete_without_where create_matview create_trigger analyze commit insert
create_table grant other alter_table create_function refresh_matview create_sequence cluster
merge alter_table create_schema do_block set create_table_partition_of""".split()
ACTION_MIX = sorted({r["kind"] for r in tables.rule_rows() if r["is_action"]})
SOURCES = ["values", "default_values", "select"]
SCOPES = ["index", "table", "schema"]
VERSIONS = [10, 12, 14, 17, 18]


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change-script corpus: one file per user, one statement per event."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    i, u = F.col("event_id"), F.col("user_id")
    kind = pick(STATEMENT_MIX, (i * 7 + u) % len(STATEMENT_MIX))
    rel = F.concat(F.lit("t"), (i % 7).cast("string"))
    other = F.concat(F.lit("t"), ((i + 3) % 7).cast("string"))
    none = F.lit(None)

    def action(step: int) -> Column:
        position = (i * 5 + u * 3 + step * 11) % len(ACTION_MIX)
        return F.struct(
            pick(ACTION_MIX, position).alias("kind"),
            F.concat(F.lit("c"), (i % 5).cast("string")).alias("column"),
            F.lit("int").alias("column_type"), F.lit("k").alias("constraint_name"),
            F.lit(False).alias("not_null"), F.lit(False).alias("not_valid"),
            F.lit(False).alias("has_using"), none.cast("string").alias("using_index"),
            F.lit(False).alias("missing_ok"), other.alias("referenced_table"),
            other.alias("partition"), none.cast("string").alias("default_volatility"),
            none.cast("string").alias("default_expression"),
            none.cast("array<string>").alias("unknown_functions"))

    two = F.array(action(0), action(1))
    attrs = F.create_map(
        F.lit("source"), pick(SOURCES, i % 3), F.lit("scope"), pick(SCOPES, i % 3),
        F.lit("no_data"), F.when(i % 2 == 0, "true").otherwise("false"),
        F.lit("mode"), (i % 8 + 1).cast("string"),
        F.lit("object_type"), F.lit("OBJECT_SEQUENCE"),
        F.lit("chain"), F.when(i % 5 == 0, "true").otherwise("false"))
    base = e.select(
        u.cast("string").alias("file_id"), i.alias("idx"), F.lit(0).alias("inner_pos"),
        (i + 1).alias("line"), kind.alias("kind"), F.lit("").alias("sql"),
        F.when(i % 10 == 0, F.array(rel, other)).otherwise(F.array(rel)).alias("targets"),
        F.when(i % 4 == 0, two).otherwise(F.slice(two, 1, 1)).alias("actions"),
        attrs.alias("attrs"),
        F.when(i % 3 == 0, F.array(other)).otherwise(F.array().cast("array<string>")
                                                     ).alias("referenced_tables"),
        F.when(i % 6 == 0, other).alias("partition_of"),
        F.concat(F.lit("ix"), (i % 9).cast("string")).alias("index_name"),
        F.when(i % 8 == 0, "gin").otherwise("btree").alias("index_method"),
        (i % 9 == 0).alias("has_expression"), other.alias("new_name"),
        (i % 2 == 0).alias("missing_ok"), F.lit(False).alias("in_block"),
        F.lit(False).alias("conditional"), (i % 40 == 0).alias("opaque"),
        (u % 5).alias("db_id"))
    inner = base.filter(F.col("kind") == "do_block").select(
        "*", F.explode(F.array(F.struct(F.lit(1).alias("p"), F.lit("drop_table").alias("k")),
                               F.struct(F.lit(2).alias("p"), F.lit("create_index").alias("k"))))
        .alias("x")).filter((F.col("idx") % 3 != 0) | (F.col("x.p") != 2)).filter(
        F.col("idx") % 5 != 0)
    block = inner.withColumns({
        "inner_pos": F.col("x.p"), "kind": F.col("x.k"), "in_block": F.lit(True),
        "conditional": F.col("idx") % 4 == 0, "opaque": F.lit(False)}).drop("x")
    return base.unionByName(block)


STATEMENTS_SQL = f"""
base AS (
  SELECT CAST(user_id AS VARCHAR) AS file_id, event_id AS idx, 0 AS inner_pos,
         event_id + 1 AS line, user_id % 5 AS db_id,
         {pick_sql(STATEMENT_MIX, f"(event_id * 7 + user_id) % {len(STATEMENT_MIX)}")} AS kind,
         't' || CAST(event_id % 7 AS VARCHAR) AS rel,
         't' || CAST((event_id + 3) % 7 AS VARCHAR) AS other,
         event_id % 10 = 0 AS two_targets,
         CASE WHEN event_id % 3 = 0 THEN 't' || CAST((event_id + 3) % 7 AS VARCHAR) END AS refs,
         CASE WHEN event_id % 6 = 0 THEN 't' || CAST((event_id + 3) % 7 AS VARCHAR) END AS parent,
         'ix' || CAST(event_id % 9 AS VARCHAR) AS index_name,
         CASE WHEN event_id % 8 = 0 THEN 'gin' ELSE 'btree' END AS index_method,
         event_id % 9 = 0 AS has_expression, event_id % 2 = 0 AS missing_ok,
         {pick_sql(SOURCES, "event_id % 3")} AS source,
         {pick_sql(SCOPES, "event_id % 3")} AS scope,
         CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS no_data,
         CAST(event_id % 8 + 1 AS VARCHAR) AS mode, event_id % 5 = 0 AS chained,
         event_id % 40 = 0 AS opaque, user_id AS u, false AS in_block, false AS conditional
  FROM events),
stmts AS (
  SELECT * FROM base
  UNION ALL
  SELECT * EXCLUDE (x) REPLACE (x.p AS inner_pos, x.k AS kind, true AS in_block, idx % 4 = 0 AS conditional,
                    false AS opaque)
  FROM (SELECT *, unnest([{{'p': 1, 'k': 'drop_table'}}, {{'p': 2, 'k': 'create_index'}}]) AS x
        FROM base WHERE kind = 'do_block' AND idx % 5 <> 0)
  WHERE idx % 3 <> 0 OR x.p <> 2)
"""


def servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version, clock and probe reading of five databases."""
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 5).alias("db_id")).agg(
        F.min(100 + F.col("event_id") % 700).alias("ms")).select(
        "db_id", F.element_at(F.array(*[F.lit(v) for v in VERSIONS]),
                              (F.col("db_id") + 1).cast("int")).alias("pg_version"),
        known(F.lit("2024-03-01 00:00:00").cast("timestamp")).alias("server_now"),
        known((F.col("ms") + F.col("db_id") * 90).cast("bigint")).alias("probe"))


SERVERS_SQL = """
servers AS (
  SELECT user_id % 5 AS db_id, ([10, 12, 14, 17, 18])[user_id % 5 + 1] AS pg_version,
         min(100 + event_id % 700) + (user_id % 5) * 90 AS probe_ms
  FROM events GROUP BY 1, 2, user_id % 5)
"""

SCALE = [1, 10, 100, 1000, 10000, 300, 30000]


def relation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and churn of seven relations in five databases, from order lines."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber",
                                                 "l_quantity")
    rel = F.col("l_suppkey") % 7
    return li.groupBy((F.col("l_orderkey") % 5).alias("db_id"), rel.alias("r")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_linenumber") == 1).alias("firsts"),
        F.sum("l_quantity").cast("bigint").alias("qty")).select(
        "db_id", F.concat(F.lit("t"), F.col("r").cast("string")).alias("relation"),
        (F.col("n") * F.element_at(F.array(*[F.lit(s) for s in SCALE]),
                                   (F.col("r") + 1).cast("int"))).alias("rows"),
        (F.col("n") * 8192 * (F.col("r") + 1)).alias("bytes"),
        (F.col("firsts") * (F.col("qty") % 6)).alias("mods"),
        (F.col("qty") % 45).alias("age_days"), F.col("r"))


RELATION_STATS_SQL = f"""
relation_stats AS (
  SELECT l_orderkey % 5 AS db_id, 't' || CAST(l_suppkey % 7 AS VARCHAR) AS relation,
         count(*) * ({SCALE})[l_suppkey % 7 + 1] AS row_count,
         count(*) * 8192 * (l_suppkey % 7 + 1) AS bytes,
         count(*) FILTER (WHERE l_linenumber = 1) * (CAST(sum(l_quantity) AS BIGINT) % 6) AS mods,
         CAST(sum(l_quantity) AS BIGINT) % 45 AS age_days, l_suppkey % 7 AS r
  FROM lineitem GROUP BY l_orderkey % 5, l_suppkey % 7)
"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation facts in snapshot form; some are missing on purpose."""
    s = relation_stats(spark, sf_dir)
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    analyzed = now - F.make_dt_interval(F.col("age_days").cast("int"))
    none_time = known(F.lit(None).cast("timestamp"))
    r, db = F.col("r"), F.col("db_id")
    c, k = "struct<name:string,attnum:int,data_type:string,not_null:boolean," \
           "has_default:boolean,identity:string,generated:string,is_domain:boolean>", \
        "struct<name:string,contype:string,validated:boolean,columns:array<string>," \
        "check_expression:string,referenced_table:string>"
    columns = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.struct(
        F.concat(F.lit("c"), j.cast("string")), j + 1, F.lit("int"),
        (j + r + db) % 3 == 0, F.lit(False), F.lit(""),
        F.when((j + r) % 4 == 0, "s").when((j + r) % 4 == 1, "v").otherwise(""),
        F.lit(False)).cast(c))
    constraint = F.struct(
        F.lit("k"), F.when(r % 3 == 0, "f").otherwise("c"), db % 2 == 0,
        F.array(F.lit("c1")), F.when(r % 3 != 0, F.lit("((c1 IS NOT NULL) AND (c1 > 0))")),
        F.when(r % 3 == 0, F.lit("t5"))).cast(k)
    index = F.struct(
        F.lit("ix").alias("name"), F.lit(True).alias("valid"),
        known(F.col("bytes")).alias("size_bytes"),
        F.when(r % 2 == 0, "btree").otherwise("gin").alias("method"),
        (r == 4).alias("partial"), F.lit(False).alias("has_expressions"),
        F.lit(True).alias("default_opclasses"),
        F.array(F.lit("c0"), F.lit("c1")).alias("depends_on"))
    return s.select("db_id", "relation", F.struct(
        known(F.lit(True)).alias("exists"),
        F.when((r == 2) & (db == 3), unavailable(F.lit("not sampled"), "bigint")).otherwise(
            known(F.col("rows"))).alias("reltuples"),
        F.when(r == 5, unavailable(F.lit("masked"), "bigint")).otherwise(
            known(F.col("mods"))).alias("n_mod"),
        F.when(r == 6, none_time).otherwise(known(analyzed)).alias("last_analyze"),
        none_time.alias("last_autoanalyze"), known(F.col("bytes")).alias("size_bytes"),
        known(F.array(index)).alias("indexes"), known(columns).alias("columns"),
        known(F.array(constraint)).alias("constraints")).alias("facts"))


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type facts of ``int`` in four of the five databases."""
    r = table(spark, sf_dir, "region").filter("r_regionkey <> 2")
    k = F.col("r_regionkey")
    return r.select(k.cast("bigint").alias("db_id"), F.lit("int").alias("type_name"), record(
        exists=known(F.lit(True)), is_domain=known(k % 2 == 1), domain_not_null=known(k == 3),
        domain_constraint_count=known(F.lit(0).cast("bigint"))).alias("type_facts"))


def type_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of any of five columns to ``int``: rewrite, relabel or unknown by relation."""
    s = relation_stats(spark, sf_dir).select("db_id", "relation", "r")
    r, no = F.col("r"), F.lit(False)
    missing = unavailable(F.lit("timeout"), "boolean")
    change = record(
        current_type=known(F.when(r % 3 == 1, "integer").otherwise("smallint")),
        current_is_domain=known(no), new_type=known(F.lit("integer")), new_is_domain=known(no),
        new_domain_not_null=known(no), new_domain_constraint_count=known(
            F.lit(0).cast("bigint")),
        new_domain_has_typmod=known(no), same_type=known(no),
        bases_same=F.when(r % 3 == 2, missing).otherwise(known(r % 3 == 1)),
        cast_method=known(F.lit("f")))
    columns = F.explode(F.array(*[F.lit(f"c{j}") for j in range(5)])).alias("column")
    return s.select("db_id", "relation", columns, F.lit("int").alias("new_type"),
                    change.alias("change"))


WAIT_MODES = ["AccessShareLock", "RowShareLock", "RowExclusiveLock", "ShareUpdateExclusiveLock",
              "ShareLock", "ShareRowExclusiveLock", "ExclusiveLock", "AccessExclusiveLock",
              "SIReadLock"]


def waiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lock waiters, one per supplier."""
    k = F.col("s_suppkey")
    idle = F.when(k % 3 == 2, unavailable(F.lit("masked"), "boolean")).otherwise(
        known(k % 3 == 0))
    return table(spark, sf_dir, "supplier").select(
        (k % 5).alias("db_id"),
        F.concat(F.lit("t"), (F.col("s_nationkey") % 7).cast("string")).alias("relation"),
        k.cast("int").alias("blocked_pid"), pick(WAIT_MODES, k % 9).alias("blocked_mode"),
        F.array(pick(WAIT_MODES, (k * 5 + 2) % 9)).alias("blocking_modes"),
        idle.alias("all_idle"))


WAITERS_SQL = """
waiters AS (
  SELECT s_suppkey % 5 AS db_id, 't' || CAST(s_nationkey % 7 AS VARCHAR) AS relation,
         unnest([s_suppkey % 9, (s_suppkey * 5 + 2) % 9]) + 1 AS level, s_suppkey % 3 = 0 AS idle
  FROM supplier)
"""
