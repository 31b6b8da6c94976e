"""The whole assessment of the event-log corpus in SQL."""

from __future__ import annotations

from changerisk.seeds import tables
from changerisk.workload.adapters import WAITERS_SQL
from changerisk.workload.sizing import SIZED
from changerisk.workload.sqltext import (
    CORPUS,
    LOCKS,
    MASKS,
    RELATION_STATS,
    RULES,
    SERVERS,
    STATE,
    TRANSACTIONS,
    UNITS,
    cte,
    resolved,
    value,
)

_KEYS = "file_id, idx, inner_pos, action_pos"
_FAMILY = value([{"k": k, "f": f} for k, f in tables.rows_family().items()])


def _rates(slower: int) -> str:
    return value([{"k": r["key"], "rate": r["value"] if r["unit"] == "ms" else max(
        1, r["value"] // slower), "spread": 40 if r["calibration"] == "uncalibrated" else 15,
        "widen": 40 if r["calibration"] == "uncalibrated" else min(max(r["spread"], 15), 20)}
        for r in tables.rate_rows()])


# What the adapter's facts say about each live action.
_NARROW = """
narrowed AS (
  SELECT *, CAST(idx % 5 AS INT) AS col, CAST(idx % 7 AS INT) AS r, CASE
    WHEN NOT (coalesce(r_live, false) AND is_action) THEN NULL
    WHEN ukind = 'add_column_default_nonvolatile' THEN CASE
      WHEN db_id = 2 THEN 'unresolved' WHEN db_id = 3 THEN 'proportional' ELSE 'constant' END
    WHEN ukind = 'add_column_default_unknown_volatility' THEN 'unresolved'
    WHEN ukind = 'alter_column_type' THEN CASE WHEN idx % 7 % 3 = 2 THEN 'unresolved'
      WHEN idx % 7 % 3 = 0 THEN 'proportional' WHEN idx % 5 <= 1 THEN 'proportional'
      ELSE 'constant' END
    WHEN ukind IN ('set_not_null', 'add_not_null_constraint') THEN CASE
      WHEN (idx % 5 + idx % 7 + db_id) % 3 = 0 THEN 'constant'
      WHEN idx % 5 = 1 AND idx % 7 % 3 <> 0 AND db_id % 2 = 0 THEN 'constant'
      ELSE 'proportional' END
    WHEN ukind = 'validate_constraint' THEN CASE WHEN db_id % 2 = 0 THEN 'constant'
      ELSE 'proportional' END
    WHEN ukind = 'drop_constraint' THEN 'constant'
    WHEN ukind = 'add_primary_key_using_index' THEN 'keep_model'
    WHEN ukind = 'set_expression' THEN CASE (idx % 5 + idx % 7) % 4 WHEN 0 THEN 'proportional'
      WHEN 1 THEN 'constant' ELSE 'unresolved' END
    END AS outcome,
    CASE WHEN NOT (coalesce(r_live, false) AND is_action) OR idx % 7 % 3 <> 0 THEN NULL
      WHEN ukind = 'drop_constraint' THEN 8
      WHEN ukind = 'validate_constraint' AND db_id % 2 = 1 THEN 2 END AS extra_level,
    CASE WHEN ukind = 'validate_constraint' AND db_id % 2 = 1 AND idx % 7 % 3 = 0
         AND coalesce(r_live, false) THEN 'fk_validation' END AS family_override,
    CASE WHEN ukind = 'alter_column_type' AND idx % 7 % 3 = 1 AND idx % 5 <= 1
         THEN CASE WHEN idx % 7 = 1 THEN 'index_build_expression' ELSE 'index_build_btree' END
         END AS rebuild,
    coalesce(ukind = 'alter_column_type' AND idx % 7 % 3 = 1 AND r_live, false) AS relabel
  FROM resolved)
"""
_NARROW_OFFLINE = """
narrowed AS (
  SELECT *, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS INT) AS extra_level,
         CAST(NULL AS VARCHAR) AS family_override, CAST(NULL AS VARCHAR) AS rebuild,
         false AS relabel FROM resolved)
"""


def _all_locks() -> str:
    return f"""
all_locks AS (
  SELECT {_KEYS}, db_id, level, relation, certain, blocks_reads, blocks_writes, true AS base
  FROM locks
  UNION ALL
  SELECT {_KEYS}, db_id, extra_level, 't5', true, (({MASKS})[extra_level + 1] & 2) <> 0,
         (({MASKS})[extra_level + 1] & 8) <> 0, false
  FROM narrowed WHERE extra_level IS NOT NULL),
stated AS (
  SELECT l.*, CASE WHEN relation IS NOT NULL
                   THEN b.st[CAST(substr(relation, 2) AS INT) + 1] END AS state
  FROM all_locks l JOIN before b ON b.file_id = l.file_id AND b.idx = l.idx)
"""


def _contention(online: bool) -> str:
    if not online:
        return f"hit AS (SELECT {_KEYS}, false AS contended, false AS active FROM narrowed)"
    return f"""
hit AS (
  SELECT {_KEYS}, bool_or(w.level IS NOT NULL) AS contended,
         bool_or(coalesce(NOT w.idle, false)) AS active
  FROM stated l LEFT JOIN waiters w ON w.db_id = l.db_id AND w.relation = l.relation
       AND l.level BETWEEN 1 AND 8
       AND (w.level = 9 OR (({MASKS})[l.level + 1] & (1 << CAST(w.level AS INT))) <> 0)
  GROUP BY {_KEYS})
"""


def _flags() -> str:
    return f"""
lock_flags AS (
  SELECT {_KEYS},
    CASE WHEN bool_or(certain AND blocks_reads) THEN 'reads'
         WHEN bool_or(certain AND blocks_writes) THEN 'writes' END AS block,
    count(*) FILTER (WHERE base AND certain AND level BETWEEN 1 AND 8) > 0
      AND NOT bool_or(base AND certain AND level BETWEEN 1 AND 8 AND relation IS NULL)
      AND NOT bool_or(certain AND relation IS NOT NULL AND state IS NULL) AS file_local,
    bool_or(certain AND level = 8 AND state IS NULL) AS live_ax
  FROM stated GROUP BY {_KEYS})
"""


def _estimates(online: bool, slower: int) -> str:
    facts = """LEFT JOIN sized s ON s.db_id = n.db_id AND s.relation =
                 CASE WHEN ukind = 'attach_partition' THEN other ELSE rel END
               LEFT JOIN factors fa ON fa.db_id = n.db_id""" if online else ""
    sized = "s.rows_, age_tenths * mods_tenths // 10 AS stale, unsized OR coalesce(swamped, false) " \
            "AS bad, factor, s.bytes" if online else \
        "CAST(NULL AS BIGINT) AS rows_, CAST(NULL AS BIGINT) AS stale, true AS bad, " \
        "CAST(NULL AS BIGINT) AS factor, CAST(NULL AS BIGINT) AS bytes"
    offline_bad = "false" if online else "true"
    return f"""
fam AS (SELECT x.k, x.f FROM (SELECT unnest({_FAMILY}) AS x)),
rate AS (SELECT x.k AS rk, x.rate, x.widen, x.spread FROM (SELECT unnest({_rates(slower)}) AS x)),
situ AS (
  SELECT n.*, {sized}, coalesce(lf.file_local, false) AS file_local, lf.block,
    coalesce(lf.live_ax, false) AS live_ax, coalesce(hit.contended, false) AS contended,
    coalesce(hit.active, false) AS active, t.explicit, t.block_id,
    b.st[CAST(CASE WHEN ukind = 'attach_partition' THEN (n.idx + 3) % 7 ELSE n.idx % 7 END
              AS INT) + 1] AS state,
    coalesce(family_override, CASE WHEN f = 'index_build_btree' AND ukind IN
      ('create_index', 'create_index_concurrently') AND (index_method <> 'btree'
       OR has_expression) THEN 'index_build_expression' ELSE f END) AS family
  FROM narrowed n {facts}
  LEFT JOIN lock_flags lf USING ({_KEYS})
  LEFT JOIN hit USING ({_KEYS})
  JOIN txns t ON t.file_id = n.file_id AND t.idx = n.idx AND t.inner_pos = n.inner_pos
  JOIN before b ON b.file_id = n.file_id AND b.idx = n.idx
  LEFT JOIN fam ON fam.k = n.ukind),
worst AS (
  SELECT situ.*, CASE WHEN state = 'clean' THEN 'constant_op' ELSE family END AS w_key,
    coalesce(state = 'loaded', false)
      OR (state IS NULL AND ({offline_bad} OR family IS NULL OR bad)) AS w_bad,
    rows_ * 1000 // r1.rate * factor // 10 AS w_prop, r1.widen * stale // 10 AS w_total,
    state = 'clean' AS w_fixed,
    bytes * 1000 // {7800000 // slower} * factor // 10 AS b_prop,
    rows_ * 1000 // r2.rate * factor // 10 AS x_prop, r2.widen * stale // 10 AS x_total
  FROM situ LEFT JOIN rate r1 ON r1.rk = family LEFT JOIN rate r2 ON r2.rk = rebuild),
branched AS (
  SELECT *, CASE
    WHEN empty THEN 'empty' WHEN r_kind IS NULL THEN 'no_rule'
    WHEN NOT r_available THEN 'unavailable'
    WHEN r_level = 9 OR r_duration = 'unknown' OR NOT r_calibrated THEN 'uncalibrated'
    WHEN r_txn = 'forbidden' AND (explicit OR in_block) THEN 'forbidden'
    WHEN file_local THEN 'file_local' WHEN ukind IN ('select', 'show') THEN 'read'
    WHEN ukind IN ('create_table_as', 'create_matview') THEN 'loading_create'
    WHEN ukind = 'insert' AND r_duration = 'matched_rows' THEN 'insert_select'
    WHEN ukind IN ('update', 'update_batched', 'delete', 'delete_batched') THEN 'matched_dml'
    WHEN ukind IN ('update_without_where', 'delete_without_where') THEN 'all_rows_dml'
    WHEN r_live THEN CASE WHEN outcome IS NULL OR outcome = 'unresolved' THEN 'live_unresolved'
      WHEN outcome = 'constant' THEN 'live_constant' WHEN outcome = 'keep_model' THEN 'generic'
      ELSE 'live_proportional' END
    ELSE 'generic' END AS branch FROM worst),
source AS (
  SELECT *, CASE
    WHEN branch = 'file_local' THEN CASE WHEN r_duration = 'constant' THEN 'fixed'
      WHEN state = 'loaded' THEN 'none' ELSE 'fixed' END
    WHEN branch IN ('all_rows_dml', 'matched_dml') THEN 'rows'
    WHEN branch = 'live_constant' THEN 'fixed'
    WHEN branch = 'live_proportional' THEN CASE WHEN rebuild IS NOT NULL THEN 'rebuild'
      ELSE 'rows' END
    WHEN branch = 'generic' THEN CASE r_duration WHEN 'constant' THEN 'fixed'
      WHEN 'index_bytes' THEN 'bytes' WHEN 'rows' THEN 'rows' ELSE 'none' END
    ELSE 'none' END AS src FROM branched),
timed AS (
  SELECT *, CASE src WHEN 'fixed' THEN 'constant_op' WHEN 'rows' THEN w_key
      WHEN 'bytes' THEN 'index_bytes'
      WHEN 'rebuild' THEN CASE WHEN state = 'clean' THEN 'constant_op' ELSE rebuild END
      END AS key_,
    CASE src WHEN 'fixed' THEN false WHEN 'rows' THEN w_bad
      WHEN 'bytes' THEN {offline_bad}
      WHEN 'rebuild' THEN state IS DISTINCT FROM 'clean' AND bad ELSE true END AS refused,
    CASE src WHEN 'rows' THEN w_prop WHEN 'bytes' THEN b_prop WHEN 'rebuild' THEN x_prop END
      AS prop,
    CASE src WHEN 'rows' THEN w_total WHEN 'bytes' THEN 15 WHEN 'rebuild' THEN x_total END
      AS total
  FROM source),
bounded AS (
  SELECT *, NOT refused AND key_ = 'constant_op' AS fixed,
    CASE WHEN refused THEN NULL WHEN key_ = 'constant_op' THEN 10 ELSE prop + 10 END AS point,
    CASE WHEN refused THEN NULL WHEN key_ = 'constant_op' THEN 100
         ELSE greatest(prop * total // 10, prop) + 100 END AS high
  FROM timed)
"""


_JUDGED = f"""
lined AS (
  SELECT *, CASE WHEN branch = 'all_rows_dml' THEN 'writes' ELSE block END AS vblock,
    CASE WHEN high < 1000 THEN 'sub_second' WHEN high < 60000 THEN 'seconds'
         WHEN high < 3600000 THEN 'minutes' WHEN high IS NOT NULL THEN 'long' END AS band_
  FROM bounded),
lines AS (
  SELECT l.*, CASE WHEN vblock = 'reads' THEN 2000 ELSE 5000 END AS short_,
    CASE WHEN vblock = 'reads' THEN 20000 ELSE 60000 END AS long_,
    (point - 10) * 10 // r.spread AS lo, (point - 10) * r.spread // 10 AS hi,
    branch = 'all_rows_dml' OR NOT (vblock = 'reads' AND live_ax) AS short_matters
  FROM lined l LEFT JOIN rate r ON r.rk = l.key_),
banded AS (
  SELECT *, CASE WHEN high < short_ THEN 'safe' WHEN high < long_ THEN 'needs_timing'
                 ELSE 'unsafe' END AS tier_,
    point > 10 AND ((lo < long_ AND long_ <= hi)
                    OR (short_matters AND lo < short_ AND short_ <= hi)) AS straddles,
    branch = 'live_proportional' OR (branch = 'generic' AND r_duration IN ('rows', 'index_bytes'))
      AS sizes
  FROM lines),
judged AS (
  SELECT *, CASE
    WHEN branch IN ('empty', 'no_rule', 'uncalibrated', 'live_unresolved') THEN 'unknown'
    WHEN branch IN ('unavailable', 'forbidden') THEN 'unsafe'
    WHEN branch IN ('file_local', 'read') THEN 'safe'
    WHEN branch IN ('loading_create', 'insert_select') THEN 'needs_timing'
    WHEN branch = 'matched_dml' THEN CASE WHEN refused THEN 'unknown' WHEN high < 5000 THEN 'safe'
      ELSE 'needs_timing' END
    WHEN branch = 'all_rows_dml' THEN CASE WHEN refused OR straddles THEN 'unknown' ELSE tier_ END
    WHEN sizes THEN CASE WHEN vblock IS NULL THEN 'safe' WHEN refused OR straddles THEN 'unknown'
      ELSE tier_ END
    WHEN branch = 'live_constant' OR r_duration = 'constant' THEN
      CASE WHEN vblock = 'reads' THEN 'needs_timing' ELSE 'safe' END
    ELSE 'unknown' END AS t0,
    CASE
    WHEN branch IN ('empty', 'no_rule', 'uncalibrated', 'live_unresolved') THEN 'unverified'
    WHEN branch IN ('unavailable', 'forbidden', 'file_local', 'read', 'loading_create',
                    'insert_select') THEN 'proven'
    WHEN branch IN ('matched_dml', 'all_rows_dml') THEN CASE WHEN refused THEN 'unverified'
      WHEN fixed THEN 'proven' ELSE 'simulated' END
    WHEN sizes AND vblock IS NULL THEN CASE WHEN branch = 'live_proportional' THEN 'observed'
      ELSE 'proven' END
    WHEN sizes THEN CASE WHEN refused THEN 'unverified'
      WHEN fixed THEN CASE WHEN branch = 'live_proportional' THEN 'observed' ELSE 'proven' END
      ELSE 'simulated' END
    WHEN branch = 'live_constant' THEN 'observed'
    WHEN r_duration = 'constant' THEN 'proven' ELSE 'unverified' END AS m0,
    coalesce(straddles AND NOT refused AND (branch = 'all_rows_dml'
      OR (sizes AND vblock IS NOT NULL)), false) AS refused_line,
    CASE WHEN branch = 'file_local' OR (sizes AND vblock IS NULL) THEN band_
      WHEN branch IN ('matched_dml', 'all_rows_dml') OR sizes THEN CASE WHEN refused THEN NULL
        ELSE band_ END
      WHEN branch = 'live_constant' OR (branch = 'generic' AND r_duration = 'constant')
      THEN 'sub_second' END AS band0
  FROM banded),
contended_ AS (
  SELECT *, CASE WHEN NOT contended OR t0 IN ('unknown', 'unsafe') THEN t0
      WHEN t0 IN ('safe', 'safe_irreversible') THEN 'needs_timing'
      WHEN active THEN 'unsafe' ELSE t0 END AS t1,
    CASE WHEN contended AND t0 NOT IN ('unknown', 'unsafe') AND (t0 = 'safe' OR active)
              AND m0 = 'proven' THEN 'observed' ELSE m0 END AS m1 FROM judged),
floored AS (
  SELECT *, CASE WHEN t1 = 'safe' AND live_ax THEN 'needs_timing' ELSE t1 END AS t2 FROM contended_),
parts AS (
  SELECT *, CASE WHEN conditional AND t2 <> 'unknown' THEN 'needs_timing' ELSE t2 END AS tier,
    m1 AS method, band0 AS band,
    CASE WHEN relabel THEN 'reversible' ELSE coalesce(r_undo, 'unknown') END AS undo
  FROM floored),
ranked AS (
  SELECT *, CASE tier WHEN 'safe' THEN 0 WHEN 'safe_irreversible' THEN 1 WHEN 'needs_timing' THEN 2
    WHEN 'unknown' THEN 3 ELSE 4 END AS rank_,
    CASE undo WHEN 'reversible' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END AS undo_rank FROM parts),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY file_id, idx ORDER BY empty, -rank_, inner_pos,
                               action_pos) AS place,
    first_value(undo) OVER (PARTITION BY file_id, idx ORDER BY empty, -undo_rank, inner_pos,
                            action_pos) AS s_undo,
    bool_or(opaque) OVER (PARTITION BY file_id, idx) AS s_opaque,
    bool_and(empty OR coalesce(fixed AND branch <> 'matched_dml', false))
      OVER (PARTITION BY file_id, idx) AS s_fixed,
    count(*) FILTER (WHERE NOT empty) OVER (PARTITION BY file_id, idx) AS s_parts,
    max(CASE WHEN inner_pos = 0 THEN kind END) OVER (PARTITION BY file_id, idx) AS s_kind,
    max(CASE WHEN r_level BETWEEN 1 AND 8 THEN r_level ELSE 0 END)
      OVER (PARTITION BY file_id, idx) AS s_level
  FROM ranked),
held_s AS (
  SELECT t.file_id, t.block_id, t.idx, max(l.level) AS level
  FROM (SELECT DISTINCT file_id, idx, block_id FROM txns WHERE explicit) t
  LEFT JOIN locks l ON l.file_id = t.file_id AND l.idx = t.idx AND l.certain
       AND l.level BETWEEN 3 AND 8 GROUP BY 1, 2, 3),
held_b AS (
  SELECT file_id, idx, coalesce(max(level) OVER (PARTITION BY file_id, block_id ORDER BY idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 5 AS holding FROM held_s),
stated_v AS (
  SELECT f.file_id, f.idx, f.s_kind AS kind, f.ukind AS deciding_kind, f.s_undo, f.s_level,
    CASE WHEN f.s_opaque AND f.tier <> 'unsafe' THEN 'unknown' ELSE f.tier END AS v1,
    CASE WHEN f.s_opaque AND f.tier <> 'unsafe' THEN 'unverified' ELSE f.method END AS vm,
    CASE WHEN f.s_opaque AND f.tier <> 'unsafe' THEN NULL ELSE f.band END AS vband,
    f.refused_line AND NOT (f.s_opaque AND f.tier <> 'unsafe') AS v_refused,
    CASE WHEN f.refused_line AND NOT (f.s_opaque AND f.tier <> 'unsafe') THEN f.tier_ END
      AS refused_from,
    coalesce(h.holding, false) AND NOT f.s_fixed AND f.s_parts > 0 AS prolongs, f.line, f.key_,
    f.high
  FROM firsts f LEFT JOIN held_b h ON h.file_id = f.file_id AND h.idx = f.idx WHERE f.place = 1),
verdicts AS (
  SELECT *, CASE WHEN v1 = 'safe' AND s_undo = 'irreversible' THEN 'safe_irreversible' ELSE v1 END
    AS v2 FROM stated_v),
statement_verdicts AS (
  SELECT file_id, idx, line, kind, deciding_kind,
    CASE WHEN prolongs AND v2 IN ('safe', 'safe_irreversible') THEN 'needs_timing' ELSE v2 END
      AS tier, vm AS method, vband AS band,
    CASE WHEN v_refused THEN 'boundary' END AS refusal, refused_from, s_undo AS reversibility,
    s_level AS lock_level FROM verdicts)
"""


def assessment(online: bool, slower: int = 1) -> str:
    """CTEs up to ``parts`` and ``statement_verdicts``, with rates divided by ``slower``."""
    version = "pg_version" if online else "17"
    facts = [RELATION_STATS, SIZED, WAITERS_SQL] if online else []
    return cte(CORPUS, UNITS, SERVERS, RULES, resolved(version), LOCKS, TRANSACTIONS, STATE, *facts,
               _NARROW if online else _NARROW_OFFLINE, _all_locks(), _contention(online), _flags(),
               _estimates(online, slower), _JUDGED, recursive=True)
