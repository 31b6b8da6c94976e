"""Rule resolution over the event-log corpus, and checks of rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changerisk import seeds
from changerisk.operators import rules

from changerisk.workload import adapters
from changerisk.workload.adapters import table
from changerisk.workload.registry import query
from changerisk.workload.sqltext import (
    CORPUS,
    LOCKS,
    MASKS,
    RULES,
    SERVERS,
    UNITS,
    cte,
    resolved,
)

_ONLINE = (CORPUS, UNITS, SERVERS, RULES, resolved("pg_version"))


def units(spark, sf) -> DataFrame:
    """Resolved statement parts, each on its database's server version."""
    statements = adapters.statements(spark, sf)
    servers = adapters.servers(spark, sf).select("db_id", "pg_version")
    keyed = rules.explode_units(statements.join(F.broadcast(servers), "db_id"))
    return rules.expand_locks(rules.apply_rules(keyed, seeds.rules(spark)))


@query("rule_lookup", cte(*_ONLINE) + """
SELECT file_id, idx, inner_pos, action_pos, ukind AS kind, in_block, conditional,
       coalesce(r_rule_ord, -1) AS rule_ord, coalesce(r_level, -1) AS level FROM resolved""")
def rule_lookup(spark, sf):
    # rule numbers restart per rule file, so actions and statements are told apart by kind
    return units(spark, sf).select(
        "file_id", "idx", "inner_pos", "action_pos", "kind", "in_block", "conditional",
        F.coalesce("rule.rule_ord", F.lit(-1)).alias("rule_ord"),
        F.coalesce("rule.level", F.lit(-1)).alias("level"))


@query("role_expansion", cte(*_ONLINE, LOCKS) + """
SELECT file_id, idx, inner_pos, action_pos, role, relation, level, certain, blocks_reads,
       blocks_writes FROM locks""")
def role_expansion(spark, sf):
    return units(spark, sf).select(
        "file_id", "idx", "inner_pos", "action_pos", F.inline("locks"))


@query("missing_required_roles", cte(*_ONLINE, LOCKS) + """
SELECT file_id, idx, x."role" AS role FROM named
WHERE x.resolvable AND NOT x.optional AND len(names) = 0""")
def missing_required_roles(spark, sf):
    return units(spark, sf).filter(F.col("missing_role").isNotNull()).select(
        "file_id", "idx", F.col("missing_role").alias("role"))


@query("conflict_expansion", cte(*_ONLINE, LOCKS) + f"""
SELECT level, count(*) AS lock_rows, bool_or(blocks_reads) AS blocks_reads,
       bool_or(blocks_writes) AS blocks_writes,
       (({MASKS})[level + 1] & 16) <> 0 AS blocks_maintenance
FROM locks GROUP BY level""")
def conflict_expansion(spark, sf):
    locks = units(spark, sf).select(F.inline("locks"))
    return locks.groupBy("level").agg(
        F.count("*").alias("lock_rows"), F.bool_or("blocks_reads").alias("blocks_reads"),
        F.bool_or("blocks_writes").alias("blocks_writes"),
        F.bool_or(F.contains(rules.blocked_behind(F.col("level")), F.lit("maintenance"))
                  ).alias("blocks_maintenance"))


@query("statement_lock_modes", cte(*_ONLINE) + """
SELECT file_id, idx, coalesce(max(r_level) FILTER (WHERE r_level BETWEEN 1 AND 8), 0)
       AS lock_level, coalesce(max(r_level), 0) AS strictest_level
FROM resolved GROUP BY file_id, idx""")
def statement_lock_modes(spark, sf):
    return rules.statement_lock_levels(units(spark, sf), ["file_id", "idx"])


@query("distinct_relations", cte(*_ONLINE, LOCKS) + """
SELECT file_id, idx, relation, role, level, bool_or(certain) AS certain,
       min(inner_pos * 100 + action_pos) AS first_part
FROM locks GROUP BY file_id, idx, relation, role, level""")
def distinct_relations(spark, sf):
    found = rules.distinct_relations(units(spark, sf), ["file_id", "idx"])
    return found.select("file_id", "idx", "relation", "role", "level", "certain",
                        (F.col("first_at.inner_pos") * 100 + F.col("first_at.action_pos")
                         ).alias("first_part"))


@query("kinds_without_rules", cte(*_ONLINE) + """
SELECT is_action, ukind AS kind, count(*) AS occurrences FROM units u
WHERE NOT EXISTS (SELECT 1 FROM rules WHERE r_kind = ukind AND r_is_action = is_action)
GROUP BY 1, 2""")
def kinds_without_rules(spark, sf):
    return rules.kinds_without_rules(units(spark, sf), seeds.rules(spark))


def rule_candidates(spark, sf) -> DataFrame:
    """A large rule table built from the parts, faults included."""
    p = table(spark, sf, "part")
    lo = (F.lit(10) + F.col("p_partkey") % 5).cast("int")
    level = (F.col("p_partkey") % 10).cast("int")
    return p.select(
        F.col("p_partkey").cast("int").alias("rule_ord"), F.lit(False).alias("is_action"),
        F.concat("p_brand", F.lit("/"), "p_type").alias("kind"), lo.alias("lo"),
        (lo + F.col("p_size") % 6).alias("hi"),
        F.when(F.col("p_partkey") % 4 == 0, F.create_map(
            F.lit("scope"), F.array(F.concat(F.lit("s"), (F.col("p_partkey") % 3).cast("string"))))
               ).otherwise(F.create_map().cast("map<string,array<string>>")).alias("when"),
        level.alias("level"), (F.col("p_size") % 2 == 0).alias("blocks_reads"),
        (F.col("p_size") % 3 == 0).alias("blocks_writes"))


_CANDIDATES = """
cand AS (SELECT p_brand || '/' || p_type AS kind, 10 + p_partkey % 5 AS lo,
                10 + p_partkey % 5 + p_size % 6 AS hi,
                CASE WHEN p_partkey % 4 = 0 THEN 's' || CAST(p_partkey % 3 AS VARCHAR) END AS cond,
                CAST(p_partkey % 10 AS INT) AS level, p_size % 2 = 0 AS br, p_size % 3 = 0 AS bw,
                p_partkey FROM part)
"""


@query("rule_coverage_gaps", cte(_CANDIDATES) + """
SELECT k.kind, v.version, count(c.kind) AS rule_count
FROM (SELECT DISTINCT kind FROM cand) k CROSS JOIN (SELECT unnest(range(10, 19)) AS version) v
LEFT JOIN cand c ON c.kind = k.kind AND c.cond IS NULL AND v.version BETWEEN c.lo AND c.hi
GROUP BY 1, 2 HAVING count(c.kind) <> 1""")
def rule_coverage_gaps(spark, sf):
    return rules.coverage_gaps(rule_candidates(spark, sf)).select(
        "kind", "version", F.col("rules").alias("rule_count"))


@query("rule_variant_overlaps", cte(_CANDIDATES) + """
SELECT kind, cond AS scope, version, count(*) AS rule_count
FROM (SELECT kind, cond, unnest(range(lo, hi + 1)) AS version FROM cand WHERE cond IS NOT NULL)
GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def rule_variant_overlaps(spark, sf):
    return rules.overlapping_variants(rule_candidates(spark, sf)).select(
        "kind", F.get_json_object("condition", "$.scope[0]").alias("scope"), "version",
        F.col("rules").alias("rule_count"))


@query("rule_breakpoint_spans", cte(_CANDIDATES) + """
SELECT c.kind, c.lo, c.hi, b.version, count(*) AS rule_count FROM cand c
JOIN (SELECT DISTINCT p_brand || '/' || p_type AS kind, 11 + p_size % 6 AS version
      FROM part) b
ON b.kind = c.kind AND c.lo < b.version AND b.version <= c.hi GROUP BY 1, 2, 3, 4""")
def rule_breakpoint_spans(spark, sf):
    points = table(spark, sf, "part").select(
        F.concat("p_brand", F.lit("/"), "p_type").alias("kind"),
        (11 + F.col("p_size") % 6).alias("version")).distinct()
    spans = rules.spanned_breakpoints(rule_candidates(spark, sf), points)
    return spans.groupBy("kind", "lo", "hi", "version").agg(F.count("*").alias("rule_count"))


@query("rule_flag_conflicts", cte(_CANDIDATES) + f"""
SELECT kind, lo, hi, level, br AS blocks_reads, bw AS blocks_writes FROM cand
WHERE (level BETWEEN 1 AND 8 AND (br <> ((({MASKS})[level + 1] & 2) <> 0)
       OR ((({MASKS})[level + 1] & 8) <> 0 AND NOT bw)))
   OR (level = 0 AND (br OR bw))""")
def rule_flag_conflicts(spark, sf):
    return rules.incoherent_flags(rule_candidates(spark, sf)).drop("is_action")


@query("asymmetric_conflicts", """
WITH c AS (SELECT DISTINCT l_suppkey AS mode, l_partkey AS other FROM lineitem)
SELECT mode, other FROM c a WHERE NOT EXISTS
  (SELECT 1 FROM c b WHERE b.mode = a.other AND b.other = a.mode)""")
def asymmetric_conflicts(spark, sf):
    pairs = table(spark, sf, "lineitem").selectExpr("l_suppkey AS mode", "l_partkey AS other")
    return rules.asymmetric_conflicts(pairs.distinct())


@query("built_in_rule_use", cte(CORPUS, UNITS, SERVERS, RULES, resolved("pg_version")) + """
SELECT is_action, r_rule_ord AS rule_ord, min(r_kind) AS kind, count(*) AS parts,
       min(pg_version) AS from_version, max(pg_version) AS to_version
FROM resolved WHERE r_rule_ord IS NOT NULL GROUP BY 1, 2""")
def built_in_rule_use(spark, sf):
    return units(spark, sf).filter(F.col("rule").isNotNull()).groupBy(
        "is_action", F.col("rule.rule_ord").alias("rule_ord")).agg(
        F.min("kind").alias("kind"), F.count("*").alias("parts"),
        F.min("pg_version").alias("from_version"), F.max("pg_version").alias("to_version"))



