"""Single verdict rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from changerisk.functions import tiers
from changerisk.operators import verdict as ve
from changerisk.seeds import tables
from changerisk.workload import adapters
from changerisk.workload.adapters import pick, pick_sql, table
from changerisk.workload.registry import query
from changerisk.workload.sqltext import MASKS
from changerisk.workload.verdictsql import assessment

_ONLINE = assessment(True)
TIERS, METHODS = list(tables.TIERS), list(tables.EVIDENCE_RANK)
_HOLD = "CAST(floor(value * 200) AS BIGINT)"
_BLOCK = "CASE WHEN user_id % 2 = 0 THEN 'reads' ELSE 'writes' END"


def holds(spark, sf):
    block = F.when(F.col("user_id") % 2 == 0, "reads").otherwise("writes")
    return table(spark, sf, "events").select(
        "event_id", "user_id", block.alias("block"),
        F.floor(F.col("value") * 200).cast("bigint").alias("hold_ms"))


@query("block_types", _ONLINE + """
SELECT file_id, idx, inner_pos, action_pos, coalesce(block, 'none') AS block FROM lock_flags""")
def block_types(spark, sf):
    from changerisk.workload.verdicts import written

    return written(spark, sf, True).parts.filter(F.size("all_locks") > 0).select(
        "file_id", "idx", "inner_pos", "action_pos",
        F.coalesce(ve.block_type(F.col("all_locks")), F.lit("none")).alias("block"))


@query("threshold_tiers", f"""
SELECT event_id, b AS block, CASE WHEN h < CASE WHEN b = 'reads' THEN 2000 ELSE 5000 END THEN 'safe'
  WHEN h < CASE WHEN b = 'reads' THEN 20000 ELSE 60000 END THEN 'needs_timing' ELSE 'unsafe' END
  AS tier FROM (SELECT event_id, {_BLOCK} AS b, {_HOLD} AS h FROM events)""")
def threshold_tiers(spark, sf):
    return holds(spark, sf).select("event_id", "block", tiers.threshold_tier(
        F.col("hold_ms"), F.col("block")).alias("tier"))


@query("boundary_refusals_by_spread", f"""
WITH e AS (SELECT event_id, {_BLOCK} AS b, {_HOLD} + 10 AS point, 15 + user_id % 30 AS spread,
                  event_id % 3 <> 0 AS short_matters FROM events),
l AS (SELECT *, greatest(point - 10, 0) AS part, CASE WHEN b = 'reads' THEN 2000 ELSE 5000 END AS s,
             CASE WHEN b = 'reads' THEN 20000 ELSE 60000 END AS g FROM e)
SELECT event_id, CASE WHEN part > 0 AND part * 10 // spread < g AND g <= part * spread // 10 THEN g
  WHEN part > 0 AND short_matters AND part * 10 // spread < s AND s <= part * spread // 10 THEN s
  ELSE -1 END AS line_ms FROM l""")
def boundary_refusals_by_spread(spark, sf):
    line = tiers.boundary_refusal(F.col("hold_ms") + 10, 15 + F.col("user_id") % 30,
                                  F.col("block"), F.col("event_id") % 3 != 0)
    return holds(spark, sf).select("event_id", F.coalesce(line, F.lit(-1)).alias("line_ms"))


def _branch(name: str, extra: str = "") -> str:
    return _ONLINE + f"""
SELECT file_id, idx, inner_pos, action_pos, t0 AS tier, m0 AS method, band0 AS band
FROM judged WHERE {name} {extra}"""


def _raw_parts(spark, sf, condition):
    """Parts of one branch that no later rule touched."""
    from changerisk.workload.verdicts import written

    v = F.col("verdict")
    return written(spark, sf, True).parts.filter(condition).select(
        "file_id", "idx", "inner_pos", "action_pos", v["tier"].alias("tier"),
        v["method"].alias("method"), v["band"].alias("band"))


def calm():
    """Parts that contention, the exclusive floor and the guard cap leave as they are."""
    return ~F.col("contended") & ~F.col("live_exclusive") & ~F.col("conditional")


_CALM = "AND NOT contended AND NOT live_ax AND NOT conditional"


@query("proportional_verdicts", _branch("sizes", _CALM))
def proportional_verdicts(spark, sf):
    sizes = (F.col("branch") == "live_proportional") | (
        (F.col("branch") == "generic") & F.col("rule.duration").isin("rows", "index_bytes"))
    return _raw_parts(spark, sf, sizes & calm())


@query("constant_verdicts", _branch(
    "(branch = 'live_constant' OR (branch = 'generic' AND r_duration = 'constant'))", _CALM))
def constant_verdicts(spark, sf):
    constant = (F.col("branch") == "live_constant") | (
        (F.col("branch") == "generic") & (F.col("rule.duration") == "constant"))
    return _raw_parts(spark, sf, constant & calm())


@query("matched_row_writes", _branch("branch = 'matched_dml'", _CALM))
def matched_row_writes(spark, sf):
    return _raw_parts(spark, sf, (F.col("branch") == "matched_dml") & calm())


@query("all_row_writes", _branch("branch = 'all_rows_dml'", _CALM))
def all_row_writes(spark, sf):
    return _raw_parts(spark, sf, (F.col("branch") == "all_rows_dml") & calm())


@query("branch_order", _ONLINE + """
SELECT branch, ukind AS kind, count(*) AS parts FROM parts GROUP BY 1, 2""")
def branch_order(spark, sf):
    from changerisk.workload.verdicts import written

    return written(spark, sf, True).parts.groupBy("branch", "kind").agg(F.count("*").alias("parts"))


def _cells(spark, sf):
    """A verdict struct per event with every tier and evidence class."""
    e = table(spark, sf, "events")
    v = ve.verdict(pick(TIERS, F.col("event_id") % 5), pick(METHODS, F.col("user_id") % 4), "x",
                   F.lit("seconds"))
    return e.select("event_id", "user_id", v.alias("v"))


_TIER = pick_sql(TIERS, "event_id % 5")
_METHOD = pick_sql(METHODS, "user_id % 4")


@query("contention_escalation", f"""
WITH e AS (SELECT event_id, {_TIER} AS t, {_METHOD} AS m, user_id % 3 > 0 AS o, user_id % 3 = 2 AS a
           FROM events)
SELECT event_id, CASE WHEN NOT o THEN t WHEN t IN ('safe', 'safe_irreversible') THEN 'needs_timing'
  WHEN t = 'needs_timing' AND a THEN 'unsafe' ELSE t END AS tier,
  CASE WHEN o AND (t IN ('safe', 'safe_irreversible') OR (t = 'needs_timing' AND a))
       AND m = 'proven' THEN 'observed' ELSE m END AS method FROM e""")
def contention_escalation(spark, sf):
    out = ve.escalate_for_contention(F.col("v"), F.col("user_id") % 3 > 0,
                                     F.col("user_id") % 3 == 2)
    rows = _cells(spark, sf).withColumn("w", out)
    return rows.select("event_id", F.col("w.tier").alias("tier"),
                       F.col("w.method").alias("method"))


@query("conditional_caps", f"""
WITH e AS (SELECT event_id, {_TIER} AS t, user_id % 2 = 0 AS c, user_id % 3 = 0 AS ax,
                  user_id % 7 = 0 AS g FROM events),
a AS (SELECT *, CASE WHEN c AND t IN ('needs_timing', 'unsafe') THEN 'needs_timing' ELSE t END AS t1
      FROM e),
b AS (SELECT *, CASE WHEN ax AND t1 IN ('safe', 'safe_irreversible') THEN 'needs_timing' ELSE t1 END
      AS t2 FROM a)
SELECT event_id, t1 AS capped, t2 AS floored,
       CASE WHEN g AND t2 <> 'unknown' THEN 'needs_timing' ELSE t2 END AS guarded FROM b""")
def conditional_caps(spark, sf):
    u = F.col("user_id")
    rows = _cells(spark, sf)
    rows = rows.withColumn("a", ve.cap_conditional_branch(
        F.col("v"), F.when(u % 2 == 0, F.lit("run in UTC"))))
    rows = rows.withColumn("b", ve.floor_for_exclusive(F.col("a"), u % 3 == 0))
    rows = rows.withColumn("c", ve.cap_for_guard(F.col("b"), u % 7 == 0))
    return rows.select("event_id", F.col("a.tier").alias("capped"),
                       F.col("b.tier").alias("floored"), F.col("c.tier").alias("guarded"))


@query("contention_match", f"""
WITH w AS (SELECT s_suppkey % 5 AS db_id, 't' || CAST(s_nationkey % 7 AS VARCHAR) AS relation,
                  unnest([s_suppkey % 9, (s_suppkey * 5 + 2) % 9]) + 1 AS level,
                  s_suppkey % 3 = 0 AS idle FROM supplier),
l AS (SELECT event_id, user_id % 5 AS db_id, 't' || CAST(event_id % 7 AS VARCHAR) AS relation,
             event_id % 8 + 1 AS level FROM events)
SELECT event_id, bool_or(w.level IS NOT NULL) AS contended,
       bool_or(coalesce(NOT w.idle, false)) AS contention_active
FROM l LEFT JOIN w ON w.db_id = l.db_id AND w.relation = l.relation
  AND (w.level = 9 OR (({MASKS})[l.level + 1] & (1 << CAST(w.level AS INT))) <> 0)
GROUP BY event_id""")
def contention_match(spark, sf):
    i = F.col("event_id")
    locks = table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 5).alias("db_id"),
        F.concat(F.lit("t"), (i % 7).cast("string")).alias("relation"),
        (i % 8 + 1).cast("int").alias("level"))
    return ve.relation_contention(locks, ve.waiter_masks(adapters.waiters(spark, sf)),
                                  ["event_id"])


@query("invalid_index_notes", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'an invalid index has this name'
  WHEN p_size % 3 = 1 THEN 'the table carries invalid indexes' END AS note FROM part""")
def invalid_index_notes(spark, sf):
    name, size = F.col("p_name"), F.col("p_size") % 3
    invalid = F.when(size == 0, F.array(F.lit("z"), name)).when(
        size == 1, F.array(F.concat(name, F.lit("_old")))).otherwise(
        F.array().cast("array<string>"))
    return table(spark, sf, "part").select("p_partkey", ve.invalid_index_note(
        name, invalid).alias("note"))


@query("statement_reversibility", _ONLINE + """
SELECT file_id, idx, reversibility, tier FROM statement_verdicts""")
def statement_reversibility(spark, sf):
    from changerisk.workload.verdicts import flat, written

    return flat(written(spark, sf, True)).select("file_id", "idx", "reversibility", "tier")


@query("weakest_evidence", f"""
WITH e AS (SELECT event_id, unnest([event_id % 4, user_id % 4, event_id // 4 % 4]) AS r FROM events)
SELECT event_id, {pick_sql(METHODS, "min(r)")} AS method FROM e GROUP BY event_id""")
def weakest_evidence(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", tiers.weakest(
        pick(METHODS, i % 4), pick(METHODS, F.col("user_id") % 4),
        pick(METHODS, (i / 4).cast("bigint") % 4)).alias("method"))

