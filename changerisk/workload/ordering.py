"""Ordered per-file state over the event-log corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changerisk import seeds
from changerisk.operators import order
from changerisk.plans.assess import resolve_units
from changerisk.workload import adapters
from changerisk.workload.adapters import table
from changerisk.workload.registry import query
from changerisk.workload.sqltext import (
    CORPUS,
    LOCKS,
    RULES,
    STATE,
    TRANSACTIONS,
    UNITS,
    cte,
    resolved,
)

_GROUPS = """
flags AS (
  SELECT file_id, idx, inner_pos, kind, chained, inside,
         inner_pos = 0 AND ((kind = 'begin' AND NOT inside)
                            OR (kind IN ('commit', 'rollback') AND inside)) AS boundary
  FROM txn),
numbered AS (
  SELECT *, CAST(coalesce(sum(CAST(boundary AS INT)) OVER (PARTITION BY file_id
            ORDER BY idx, inner_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            + CASE WHEN kind = 'begin' AND boundary THEN 1 ELSE 0 END AS BIGINT) AS group_no
  FROM flags)
"""


@query("transaction_groups", cte(CORPUS, TRANSACTIONS, _GROUPS) + """
SELECT file_id, idx, inner_pos, group_no, inside,
       CASE WHEN inner_pos = 0 AND kind = 'begin' AND inside THEN 'begin inside an open block'
            WHEN inner_pos = 0 AND kind IN ('commit', 'rollback') AND NOT inside
            THEN 'no block to close' END AS warning FROM numbered""")
def transaction_groups(spark, sf):
    return order.transaction_groups(adapters.statements(spark, sf)).select(
        "file_id", "idx", "inner_pos", "group_no", "inside", "warning")


@query("transaction_summary", cte(CORPUS, TRANSACTIONS, _GROUPS) + """
, rows_ AS (
  SELECT file_id, group_no, idx, kind, boundary, false AS by_chain FROM numbered
  WHERE inner_pos = 0
  UNION ALL SELECT file_id, group_no + 1, idx, kind, true, true FROM numbered
  WHERE inner_pos = 0 AND boundary AND chained AND kind <> 'begin'),
g AS (
  SELECT file_id, group_no, count(*) FILTER (WHERE kind NOT IN ('begin', 'commit', 'rollback'))
           AS statements,
         min(idx) FILTER (WHERE boundary AND (kind = 'begin' OR by_chain)) AS opened,
         min(idx) FILTER (WHERE boundary AND kind <> 'begin' AND NOT by_chain) AS closed,
         coalesce(bool_or(boundary AND kind = 'rollback' AND NOT by_chain), false) AS rolled_back
  FROM rows_ GROUP BY 1, 2)
SELECT file_id, group_no, statements, coalesce(opened, -1) AS opened_by,
       coalesce(closed, -1) AS closed_by, rolled_back, opened IS NOT NULL AS explicit,
       opened IS NOT NULL AND closed IS NULL AS never_closed
FROM g WHERE statements > 0 OR opened IS NOT NULL""")
def transaction_summary(spark, sf):
    grouped = order.transaction_groups(adapters.statements(spark, sf))
    return order.transaction_summary(grouped).withColumns({
        "opened_by": F.coalesce("opened_by", F.lit(-1)),
        "closed_by": F.coalesce("closed_by", F.lit(-1))})


def baseline_corpus(spark, sf) -> DataFrame:
    """Larger files, many of which create what they touch first."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    key, file_no = F.col("o_orderkey"), F.col("o_orderkey") % 60
    # the first statements of a file create; some files touch a name of another
    creates = F.col("o_orderkey") < 60 * 30
    kind = F.when(creates, adapters.pick(["create_table", "create_view", "create_sequence"],
                                         key % 3)).otherwise(
        adapters.pick(["create_index", "alter_table", "insert", "drop_table", "rename_table",
                       "create_table_partition_of", "select", "comment_on"],
                      (key / 60).cast("bigint") % 8))
    step = (key / 60).cast("bigint")
    name = F.when(creates, step).otherwise(
        F.when((file_no % 5 == 0) & (step % 40 == 7), F.lit(999)).otherwise(step % 30))
    rel = F.concat(F.lit("s.r"), name.cast("string"))
    missing = F.concat(F.lit("r"), (step % 35).cast("string"))
    return o.select(
        file_no.cast("string").alias("file_id"), key.alias("idx"), F.lit(0).alias("inner_pos"),
        kind.alias("kind"), F.array(rel).alias("targets"),
        F.when(file_no % 7 == 3, missing).alias("partition_of"),
        F.concat(F.lit("i"), step.cast("string")).alias("index_name"),
        F.concat(F.lit("n"), step.cast("string")).alias("new_name"),
        (key % 2 == 0).alias("missing_ok"))


@query("baseline_files", """
WITH s AS (
  SELECT o_orderkey % 60 AS f, o_orderkey AS idx, o_orderkey // 60 AS step,
         o_orderkey < 1800 AS creating FROM orders),
t AS (
  SELECT *, CASE WHEN creating THEN (['create_table','create_view','create_sequence'])[idx % 3 + 1]
    ELSE (['create_index','alter_table','insert','drop_table','rename_table',
           'create_table_partition_of','select','comment_on'])[step % 8 + 1] END AS kind,
    'r' || CAST(CASE WHEN creating THEN step WHEN f % 5 = 0 AND step % 40 = 7 THEN 999
                     ELSE step % 30 END AS VARCHAR) AS name FROM s),
e AS (
  SELECT f, name, CASE WHEN kind IN ('create_table','create_view','create_sequence',
      'create_table_partition_of') THEN idx * 2 END AS made,
    CASE WHEN kind IN ('create_index','alter_table','insert','rename_table')
          OR (kind = 'drop_table' AND idx % 2 <> 0) THEN idx * 2 END AS used FROM t
  UNION ALL SELECT f, 'r' || CAST(step % 35 AS VARCHAR), NULL, idx * 2 + 1 FROM t
    WHERE f % 7 = 3 AND kind IN ('create_table','create_view','create_sequence',
                                 'create_table_partition_of')
  UNION ALL SELECT f, 'i' || CAST(step AS VARCHAR), idx * 2 + 1, NULL FROM t
    WHERE kind = 'create_index'
  UNION ALL SELECT f, 'n' || CAST(step AS VARCHAR), idx * 2 + 1, NULL FROM t
    WHERE kind = 'rename_table'),
n AS (SELECT f, name, min(made) AS made, min(used) AS used FROM e GROUP BY 1, 2)
SELECT CAST(c.f AS VARCHAR) AS file_id, c.statements,
       c.statements >= 50 AND bool_and(n.used IS NULL OR coalesce(n.made < n.used, false))
         AS baseline
FROM (SELECT f, count(*) AS statements FROM s GROUP BY 1) c JOIN n ON n.f = c.f GROUP BY 1, 2""")
def baseline_files(spark, sf):
    return order.baseline_files(baseline_corpus(spark, sf))


@query("created_state", cte(CORPUS, STATE, recursive=True) + """
SELECT DISTINCT s.file_id, s.idx, n.name, b.st[n.i + 1] AS state
FROM (SELECT DISTINCT file_id, idx FROM stmts) s
JOIN before b ON b.file_id = s.file_id AND b.idx = s.idx
CROSS JOIN LATERAL (SELECT CAST(s.idx % 7 AS INT) AS i,
                           't' || CAST(s.idx % 7 AS VARCHAR) AS name
                    UNION ALL SELECT CAST((s.idx + 3) % 7 AS INT),
                           't' || CAST((s.idx + 3) % 7 AS VARCHAR)) n""")
def created_state(spark, sf):
    statements = adapters.statements(spark, sf)
    names = F.array(F.concat(F.lit("t"), (F.col("idx") % 7).cast("string")),
                    F.concat(F.lit("t"), ((F.col("idx") + 3) % 7).cast("string")))
    asked = statements.filter("inner_pos = 0").select(
        "file_id", "idx", "inner_pos", F.explode(names).alias("name"))
    return order.created_state(statements, asked).drop("inner_pos")


def offline_units(spark, sf) -> DataFrame:
    return resolve_units(adapters.statements(spark, sf), seeds.rules(spark), pg_version=17)


_OFFLINE = (CORPUS, UNITS, RULES, resolved("17"), LOCKS, TRANSACTIONS)


@query("held_locks", cte(*_OFFLINE) + """
, taken AS (
  SELECT t.file_id, t.block_id, t.idx, count(l.level) AS n, max(l.level) AS level
  FROM (SELECT DISTINCT file_id, idx, block_id FROM txns WHERE explicit) t
  LEFT JOIN locks l ON l.file_id = t.file_id AND l.idx = t.idx AND l.certain
       AND l.level BETWEEN 3 AND 8 GROUP BY 1, 2, 3)
SELECT file_id, block_id, idx, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS held,
       coalesce(max(level) OVER w, 0) AS held_level,
       coalesce(max(level) OVER w, 0) >= 5 AS blocking_held
FROM taken WINDOW w AS (PARTITION BY file_id, block_id ORDER BY idx
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def held_locks(spark, sf):
    return order.held_locks(offline_units(spark, sf))


@query("exclusive_accumulation", cte(*_OFFLINE) + """
, ax AS (
  SELECT t.file_id, t.block_id, t.explicit, l.relation, min(l.idx) AS since
  FROM locks l JOIN txns t ON t.file_id = l.file_id AND t.idx = l.idx
       AND t.inner_pos = l.inner_pos
  JOIN stmts s ON s.file_id = l.file_id AND s.idx = l.idx AND s.inner_pos = l.inner_pos
  WHERE l.certain AND l.level = 8 AND l.relation IS NOT NULL AND NOT s.conditional
  GROUP BY 1, 2, 3, 4),
held AS (
  SELECT file_id, block_id, relation, since, false AS hypothetical FROM ax WHERE explicit
  UNION ALL
  SELECT file_id, -1, relation, min(since), true FROM ax
  WHERE file_id NOT IN (SELECT file_id FROM stmts WHERE kind = 'begin' AND inner_pos = 0)
  GROUP BY 1, 3)
SELECT *, count(*) OVER (PARTITION BY file_id, block_id, hypothetical) AS relations FROM held
QUALIFY count(*) OVER (PARTITION BY file_id, block_id, hypothetical) >= 2""")
def exclusive_accumulation(spark, sf):
    return order.exclusive_accumulation(offline_units(spark, sf))


@query("unwrappable_files", cte(*_OFFLINE) + """
SELECT r.file_id FROM resolved r JOIN txns t USING (file_id, idx, inner_pos)
GROUP BY r.file_id
HAVING bool_or(coalesce(r_txn = 'forbidden' AND NOT t.explicit AND NOT r.in_block, false))
   AND NOT bool_or(r.kind = 'begin' AND r.inner_pos = 0)""")
def unwrappable_files(spark, sf):
    return order.unwrappable_files(offline_units(spark, sf))


@query("replay_order", """
WITH f AS (SELECT 'repo' || CAST(doc_id % 3 AS VARCHAR) AS repo, doc_id * 7 % 1000 AS number,
  'repo' || CAST(doc_id % 3 AS VARCHAR) || '__' || CAST(doc_id * 7 % 1000 AS VARCHAR) || '__'
  || source || '__' || CAST(doc_id AS VARCHAR) || '.sql' AS file_name FROM documents)
SELECT repo, number, file_name, count(*) OVER w AS earlier, last_value(file_name) OVER w AS previous
FROM f WINDOW w AS (PARTITION BY repo ORDER BY number, file_name
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def replay_order(spark, sf):
    d, repo = F.col("doc_id"), F.concat(F.lit("repo"), (F.col("doc_id") % 3).cast("string"))
    name = F.concat(repo, F.lit("__"), (d * 7 % 1000).cast("string"), F.lit("__"),
                    F.col("source"), F.lit("__"), d.cast("string"), F.lit(".sql"))
    return order.replay_order(table(spark, sf, "documents").select(name.alias("file_name")))
