"""Rollups of the assessed corpus to files, runs and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changerisk.functions import tiers
from changerisk.operators import rollup
from changerisk.seeds import tables
from changerisk.workload import adapters
from changerisk.workload.adapters import pick, pick_sql, table
from changerisk.workload.registry import query
from changerisk.workload.verdicts import OFFLINE, ONLINE, flat, online, written

_COUNTS = ", ".join(f"count(*) FILTER (WHERE tier = '{t}') AS {t}" for t in tables.TIERS)
_RANK = ("CASE tier WHEN 'safe' THEN 0 WHEN 'safe_irreversible' THEN 1 WHEN 'needs_timing' THEN 2 "
         "WHEN 'unknown' THEN 3 ELSE 4 END")
_FILE = ("CASE max({r}) WHEN 2 THEN 'requires_approval' WHEN 3 THEN 'requires_approval' "
         "WHEN 4 THEN 'block' ELSE 'proceed' END").format(r=_RANK)


@query("blocking_files", ONLINE + f"""
SELECT file_id, {_FILE} AS verdict, {_COUNTS},
       coalesce(min(idx) FILTER (WHERE tier = 'unsafe'), -1) AS first_unsafe
FROM statement_verdicts GROUP BY file_id""")
def blocking_files(spark, sf):
    """Which files block, and where: the flagship query."""
    statements = flat(online(spark, sf))
    return statements.groupBy("file_id").agg(
        tiers.file_verdict(F.max(tiers.tier_rank(F.col("tier")))).alias("verdict"),
        *[F.count_if(F.col("tier") == t).alias(t) for t in tables.TIERS],
        F.coalesce(F.min(F.when(F.col("tier") == "unsafe", F.col("idx"))), F.lit(-1)
                   ).alias("first_unsafe"))


@query("tier_counts", OFFLINE + f"""
SELECT file_id, {_COUNTS} FROM statement_verdicts GROUP BY file_id""")
def tier_counts(spark, sf):
    return rollup.tier_counts(flat(written(spark, sf, False)), ["file_id"])


@query("file_verdicts", OFFLINE + f"""
, f AS (SELECT CAST(c_custkey AS VARCHAR) AS file_id FROM customer),
v AS (SELECT file_id, {_FILE} AS verdict FROM statement_verdicts GROUP BY 1)
SELECT f.file_id, coalesce(v.verdict, 'proceed') AS verdict FROM f LEFT JOIN v USING (file_id)""")
def file_verdicts(spark, sf):
    files = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("file_id"))
    return rollup.file_verdicts(files, flat(written(spark, sf, False)))


VERDICTS = ["proceed", "requires_approval", "block"]
STATUSES = ["assessed", "unsupported", "error", "assessed", "assessed"]


def outcomes(spark, sf) -> DataFrame:
    """CI file outcomes: one file per order, one run per customer."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    counts = [((key + i) % 4).alias(t) for i, t in enumerate(tables.TIERS)]
    return o.select(
        F.col("o_custkey").alias("run_id"), key.alias("file_id"),
        pick(STATUSES, key % 5).alias("status"),
        F.when(key % 11 != 0, pick(VERDICTS, key % 3)).alias("verdict"), *counts)


_OUTCOMES = f"""
WITH o AS (SELECT o_custkey AS run_id, o_orderkey AS file_id,
  {pick_sql(STATUSES, "o_orderkey % 5")} AS status,
  CASE WHEN o_orderkey % 11 <> 0 THEN {pick_sql(VERDICTS, "o_orderkey % 3")} END AS verdict,
  {", ".join(f"(o_orderkey + {i}) % 4 AS {t}" for i, t in enumerate(tables.TIERS))} FROM orders)
"""
_RUN = """
CASE max(CASE WHEN status <> 'assessed' OR verdict IS NULL OR verdict = 'requires_approval' THEN 1
         WHEN verdict = 'block' THEN 2 ELSE 0 END)
     WHEN 0 THEN 'proceed' WHEN 1 THEN 'requires_approval' ELSE 'block' END"""


@query("run_verdicts", _OUTCOMES + f"""
SELECT run_id, {_RUN} AS verdict FROM o GROUP BY run_id""")
def run_verdicts(spark, sf):
    return rollup.run_verdicts(outcomes(spark, sf))


@query("run_summary", _OUTCOMES + f"""
SELECT run_id, coalesce(file_id, -1) AS file_id, count(*) AS detected,
  count(*) FILTER (WHERE status = 'assessed') AS assessed,
  count(*) FILTER (WHERE status = 'unsupported') AS unsupported,
  count(*) FILTER (WHERE status = 'error') AS errors,
  {", ".join(f"CAST(coalesce(sum({t}) FILTER (WHERE status = 'assessed'), 0) AS BIGINT) AS {t}" for t in tables.TIERS)}
FROM o GROUP BY ROLLUP (run_id, file_id) HAVING run_id IS NOT NULL""")
def run_summary(spark, sf):
    return rollup.run_summary(outcomes(spark, sf)).withColumn(
        "file_id", F.coalesce("file_id", F.lit(-1)))


GATES = ["never", "block", "requires_approval"]


@query("gate_codes", f"""
WITH e AS (SELECT event_id, {pick_sql(VERDICTS, "event_id % 3")} AS v,
                  {pick_sql(GATES, "user_id % 3")} AS g FROM events)
SELECT v AS verdict, g AS fail_on, CASE WHEN g = 'never' THEN 0 WHEN v = 'block' THEN 2
  WHEN v = 'requires_approval' AND g = 'requires_approval' THEN 1 ELSE 0 END AS exit_code,
  count(*) AS runs FROM e GROUP BY 1, 2, 3""")
def gate_codes(spark, sf):
    rows = table(spark, sf, "events").select(
        pick(VERDICTS, F.col("event_id") % 3).alias("verdict"),
        pick(GATES, F.col("user_id") % 3).alias("fail_on"))
    return rows.withColumn("exit_code", tiers.exit_code(F.col("verdict"), F.col("fail_on"))
                           ).groupBy("verdict", "fail_on", "exit_code").agg(
        F.count("*").alias("runs"))


@query("irreversible_ledger", OFFLINE + """
SELECT file_id, idx, line, kind FROM statement_verdicts WHERE reversibility = 'irreversible'""")
def irreversible_ledger(spark, sf):
    return rollup.irreversible_ledger(flat(written(spark, sf, False))).drop("lost")


@query("rollback_feasibility", OFFLINE + """
SELECT file_id, count(*) FILTER (WHERE reversibility = 'irreversible') AS blockers,
  count(*) FILTER (WHERE reversibility = 'unknown') AS undecided,
  CASE WHEN bool_or(reversibility = 'irreversible') THEN 'no'
       WHEN bool_or(reversibility = 'unknown') THEN 'unknown' ELSE 'yes' END AS feasible
FROM statement_verdicts GROUP BY file_id""")
def rollback_feasibility(spark, sf):
    return rollup.rollback_feasibility(flat(written(spark, sf, False)))


@query("rollback_reasons", OFFLINE + """
SELECT file_id, idx, CASE WHEN reversibility = 'irreversible' THEN 'blocker' ELSE 'undecided' END
  AS role FROM statement_verdicts WHERE reversibility <> 'reversible'""")
def rollback_reasons(spark, sf):
    return rollup.rollback_reasons(flat(written(spark, sf, False))).select("file_id", "idx", "role")


@query("unverified_ledger", OFFLINE + """
, refused_parts AS (
  SELECT file_id, idx FROM parts WHERE branch IN ('empty', 'no_rule', 'unavailable',
    'uncalibrated', 'forbidden', 'read', 'loading_create', 'insert_select', 'live_unresolved',
    'matched_dml') OR (branch IN ('generic', 'all_rows_dml', 'file_local') AND refused))
SELECT source, count(*) AS entries FROM (
  SELECT DISTINCT file_id, 'no_snapshot' AS source FROM stmts
  UNION ALL SELECT DISTINCT file_id, 'execution_state' FROM stmts
  UNION ALL SELECT file_id, 'unknown_classification' FROM statement_verdicts WHERE tier = 'unknown'
  UNION ALL SELECT file_id, 'cannot_estimate' FROM refused_parts
  UNION ALL SELECT DISTINCT file_id, 'uncalibrated_constant' FROM parts
    WHERE NOT coalesce(refused, true) AND branch <> 'matched_dml')
GROUP BY source""")
def unverified_ledger(spark, sf):
    assessed = written(spark, sf, False)
    ledger = rollup.unverified_ledger(assessed.parts, flat(assessed), online=False)
    return ledger.groupBy("source").agg(F.count("*").alias("entries"))


@query("rules_used", OFFLINE + """
SELECT file_id, idx, inner_pos, action_pos, ukind AS kind, r_rule_ord AS rule_ord,
       CAST(len(roles) AS INT) AS roles, in_block, conditional
FROM parts WHERE r_kind IS NOT NULL""")
def rules_used(spark, sf):
    return rollup.rules_used(written(spark, sf, False).parts).drop("relations", "is_action")


@query("tier_distribution", OFFLINE + """
SELECT 'tier' AS dimension, tier AS value, count(*) AS n,
       CAST(1000 * count(*) // sum(count(*)) OVER () AS BIGINT) AS per_mille
FROM statement_verdicts GROUP BY tier
UNION ALL
SELECT 'method', method, count(*), CAST(1000 * count(*) // sum(count(*)) OVER () AS BIGINT)
FROM statement_verdicts GROUP BY method""")
def tier_distribution(spark, sf):
    statements = flat(written(spark, sf, False))
    return rollup.distribution(statements, "tier").unionByName(
        rollup.distribution(statements, "method"))


@query("top_kinds", OFFLINE + """
SELECT tier, kind, n, place FROM (
  SELECT tier, kind, count(*) AS n,
         row_number() OVER (PARTITION BY tier ORDER BY count(*) DESC, kind) AS place
  FROM statement_verdicts GROUP BY tier, kind) WHERE place <= 20""")
def top_kinds(spark, sf):
    return rollup.top_kinds(flat(written(spark, sf, False)))


@query("exemplars", OFFLINE + """
SELECT kind, file_id, idx, place FROM (
  SELECT kind, file_id, idx, row_number() OVER (PARTITION BY kind ORDER BY file_id, idx) AS place
  FROM stmts WHERE inner_pos = 0) WHERE place <= 6""")
def exemplars(spark, sf):
    statements = adapters.statements(spark, sf).filter("inner_pos = 0")
    return rollup.exemplars(statements.select("kind", "file_id", "idx"))


_BUCKETS = OFFLINE + """
, undecided AS (
  SELECT v.file_id, v.idx, v.kind, CASE WHEN f.s_opaque THEN 'opaque_do_block'
    WHEN branch = 'empty' THEN 'empty_do_block'
    WHEN branch = 'uncalibrated' AND r_level = 9 THEN 'unmodeled_form'
    WHEN branch = 'uncalibrated' THEN 'uncalibrated_row' ELSE 'other' END AS bucket
  FROM firsts f JOIN statement_verdicts v ON v.file_id = f.file_id AND v.idx = f.idx
  WHERE f.place = 1 AND v.tier = 'unknown')
"""


@query("unknown_diagnosis", _BUCKETS + """
SELECT bucket, kind, count(*) AS n FROM undecided GROUP BY 1, 2""")
def unknown_diagnosis(spark, sf):
    return rollup.unknown_buckets(flat(written(spark, sf, False)), ["kind"])


@query("unknown_samples", _BUCKETS + """
SELECT bucket, file_id, idx, kind,
       row_number() OVER (PARTITION BY bucket ORDER BY file_id, idx) AS place FROM undecided
QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY file_id, idx) <= 12""")
def unknown_samples(spark, sf):
    return rollup.unknown_samples(flat(written(spark, sf, False))).select(
        "bucket", "place", "file_id", "idx", "kind")


@query("unknown_transitions", f"""
{OFFLINE}
SELECT count(*) AS undecided FROM statement_verdicts WHERE tier = 'unknown'""")
def unknown_transitions(spark, sf):
    moved = rollup.unknown_transitions(flat(written(spark, sf, False)), flat(written(spark, sf, True)))
    return moved.agg(F.sum("n").alias("undecided"))
