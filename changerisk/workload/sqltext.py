"""SQL fragments the checks share: the corpus, the rules and their resolution."""

from __future__ import annotations

from changerisk.seeds import tables
from changerisk.workload.adapters import (
    ACTION_MIX,
    RELATION_STATS_SQL,
    SERVERS_SQL,
    STATEMENTS_SQL,
    pick_sql,
)


def value(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, list):
        return "[" + ", ".join(value(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"'{k}': {value(x)}" for k, x in v.items()) + "}"
    return "'" + str(v).replace("'", "''") + "'"


_RULE_COLUMNS = ("rule_ord", "kind", "is_action", "lo", "hi", "level", "blocks_reads",
                 "blocks_writes", "rewrite", "duration", "available", "calibrated", "live",
                 "txn", "undo")


def _rule_values() -> str:
    rows = []
    for rule in tables.rule_rows():
        when = list(rule["when"].items())
        key, values = when[0] if when else (None, ["-"])
        cells = [value(rule[c]) for c in _RULE_COLUMNS]
        roles = value(rule["affected"]) if rule["affected"] else \
            "[]::STRUCT(\"role\" VARCHAR, \"level\" INTEGER, optional BOOLEAN, resolvable BOOLEAN)[]"
        rows.append("(" + ", ".join([*cells, value(key), value(values), roles]) + ")")
    return ",\n".join(rows)


RULES = (f"rules({', '.join('r_' + c for c in _RULE_COLUMNS)}, when_key, when_values, roles) AS "
         f"(VALUES\n{_rule_values()})")
MASKS = value([tables.conflict_masks()[n] for n in range(10)])

UNITS = f"""
alters AS (SELECT *, unnest([0, 1]) AS action_pos FROM stmts WHERE kind = 'alter_table'),
units AS (
  SELECT *, 0 AS action_pos, kind AS ukind, false AS is_action, kind = 'do_block' AS empty
  FROM stmts WHERE kind <> 'alter_table'
  UNION ALL
  SELECT *, {pick_sql(ACTION_MIX, f"(idx * 5 + u * 3 + action_pos * 11) % {len(ACTION_MIX)}")},
         true, false
  FROM alters WHERE action_pos = 0 OR idx % 4 = 0)
"""


def resolved(version: str) -> str:
    """The rule of every unit; ``version`` is a number or a column of servers."""
    join = "JOIN servers USING (db_id)" if version == "pg_version" else ""
    return f"""
resolved AS (
  SELECT u.*, r.*{', pg_version, probe_ms' if join else ''} FROM units u {join}
  LEFT JOIN rules r ON r_kind = ukind AND r_is_action = is_action AND NOT empty
       AND {version} BETWEEN r_lo AND r_hi
       AND (when_key IS NULL OR list_contains(when_values, CASE when_key
            WHEN 'source' THEN source WHEN 'no_data' THEN no_data WHEN 'scope' THEN scope
            WHEN 'mode' THEN mode WHEN 'object_type' THEN 'OBJECT_SEQUENCE' END))
  QUALIFY row_number() OVER (PARTITION BY file_id, idx, inner_pos, action_pos
                             ORDER BY when_key IS NULL, r_rule_ord) = 1)
"""


LOCKS = f"""
roles_x AS (
  SELECT file_id, idx, inner_pos, action_pos, db_id, rel, other, two_targets, refs, parent,
         is_action, unnest(roles) AS x, generate_subscripts(roles, 1) AS role_pos
  FROM resolved),
named AS (
  SELECT *, CASE x."role" WHEN 'target' THEN [rel]
      WHEN 'additional_targets' THEN CASE WHEN two_targets THEN [other] ELSE [] END
      WHEN 'referenced_table' THEN CASE WHEN is_action THEN [other] ELSE [] END
      WHEN 'referenced_tables' THEN CASE WHEN refs IS NOT NULL THEN [refs] ELSE [] END
      WHEN 'partition' THEN CASE WHEN is_action THEN [other] ELSE [] END
      WHEN 'parent' THEN CASE WHEN parent IS NOT NULL THEN [parent] ELSE [] END
      ELSE [NULL::VARCHAR] END AS names FROM roles_x),
locks AS (
  SELECT file_id, idx, inner_pos, action_pos, db_id, role_pos, x."role" AS role,
         x."level" AS level, unnest(names) AS relation,
         x.resolvable OR NOT x.optional AS certain,
         (({MASKS})[x."level" + 1] & 2) <> 0 AS blocks_reads,
         (({MASKS})[x."level" + 1] & 8) <> 0 AS blocks_writes
  FROM named)
"""

TRANSACTIONS = """
marks AS (
  SELECT file_id, idx, inner_pos, kind, chained,
         CASE WHEN inner_pos > 0 THEN NULL WHEN kind = 'begin' THEN 1
              WHEN kind IN ('commit', 'rollback') AND NOT chained THEN 0 END AS m,
         CASE WHEN inner_pos = 0 AND kind IN ('commit', 'rollback') THEN idx END AS c
  FROM stmts),
txn AS (
  SELECT *, coalesce(last_value(m IGNORE NULLS) OVER w, 0) = 1 AS inside,
         coalesce(max(c) OVER w, -1) AS block_id
  FROM marks WINDOW w AS (PARTITION BY file_id ORDER BY idx, inner_pos
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
txns AS (
  SELECT file_id, idx, inner_pos, inside, block_id,
         inside AND NOT (inner_pos = 0 AND kind IN ('begin', 'commit', 'rollback')) AS explicit
  FROM txn)
"""

# What a file has created, folded statement by statement over its seven names.
STATE = """
steps AS (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY idx, inner_pos) AS rn,
         CAST(idx % 7 AS INT) AS a, CAST((idx + 3) % 7 AS INT) AS b FROM stmts),
fold AS (
  SELECT DISTINCT file_id, CAST(0 AS BIGINT) AS rn,
         [NULL, NULL, NULL, NULL, NULL, NULL, NULL]::VARCHAR[] AS st FROM stmts
  UNION ALL
  SELECT f.file_id, s.rn, list_transform(range(0, 7), lambda i: CASE
    WHEN s.kind IN ('create_table', 'create_table_partition_of') AND i = s.a THEN 'clean'
    WHEN s.kind IN ('create_table_as', 'select_into', 'create_matview') AND i = s.a THEN 'loaded'
    WHEN s.kind = 'drop_table' AND (i = s.a OR (s.two_targets AND i = s.b)) THEN NULL
    WHEN s.kind = 'rename_table' AND f.st[s.a + 1] IS NOT NULL AND i = s.a THEN NULL
    WHEN s.kind = 'rename_table' AND f.st[s.a + 1] IS NOT NULL AND i = s.b THEN f.st[s.a + 1]
    WHEN (s.kind IN ('copy_from', 'merge') OR (s.kind = 'insert' AND s.source = 'select'))
         AND i = s.a AND f.st[s.a + 1] IS NOT NULL THEN 'loaded'
    ELSE f.st[i + 1] END)
  FROM fold f JOIN steps s ON s.file_id = f.file_id AND s.rn = f.rn + 1),
before AS (
  SELECT s.file_id, s.idx, f.st FROM (SELECT file_id, idx, min(rn) AS rn FROM steps
                                      GROUP BY file_id, idx) s
  JOIN fold f ON f.file_id = s.file_id AND f.rn = s.rn - 1)
"""


def cte(*parts: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(p.strip() for p in parts) + "\n"


CORPUS = STATEMENTS_SQL
SERVERS = SERVERS_SQL
RELATION_STATS = RELATION_STATS_SQL
