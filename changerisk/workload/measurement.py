"""Throughput readings, interval coverage and comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changerisk.operators import compare as cm
from changerisk.operators import measure as me
from changerisk.seeds import tables
from changerisk.workload import adapters
from changerisk.workload.adapters import pick, pick_sql, table
from changerisk.workload.registry import query
from changerisk.workload.verdictsql import assessment

FAMILIES = ["heap_rewrite", "dml_update", "index_bytes", "constant_op", "validation_scan"]
SIZES = ["t_1k", "t_100k", "t_1m", "t_10m"]
TIERS = list(tables.TIERS)


def readings(spark, sf) -> DataFrame:
    """Profile readings: one per line item."""
    p, k = F.col("l_partkey"), F.col("l_orderkey")
    return table(spark, sf, "lineitem").select(
        pick(FAMILIES, F.col("l_suppkey") % 5).alias("family"),
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("profile"),
        (F.col("l_linenumber") * 150_000 + k % 7 * 200_000).cast("bigint").alias("rows"),
        F.floor("l_extendedprice").cast("bigint").alias("ms"),
        (p % 31 == 0).alias("error"), (k * 1000).alias("index_bytes"))


_READINGS = f"""
WITH rd AS (SELECT {pick_sql(FAMILIES, "l_suppkey % 5")} AS family,
    l_returnflag || '-' || l_linestatus AS profile,
    l_linenumber * 150000 + l_orderkey % 7 * 200000 AS rows_,
    CAST(floor(l_extendedprice) AS BIGINT) AS ms, l_partkey % 31 = 0 AS error,
    l_orderkey * 1000 AS bytes FROM lineitem),
rate AS (SELECT *, CASE WHEN family = 'constant_op' THEN ms
      WHEN family = 'index_bytes' THEN bytes * 1000 // ms ELSE rows_ * 1000 // ms END AS rate
  FROM rd WHERE NOT error AND ms > 0
    AND rows_ >= CASE WHEN family = 'dml_update' THEN 100000 ELSE 1000000 END)
"""


@query("reading_rates", _READINGS + """
SELECT family, profile, rate, count(*) AS readings FROM rate GROUP BY 1, 2, 3""")
def reading_rates(spark, sf):
    return me.scale_readings(readings(spark, sf)).groupBy("family", "profile", "rate").agg(
        F.count("*").alias("readings"))


def probes(spark, sf) -> DataFrame:
    return readings(spark, sf).select("profile", (F.col("ms") % 400 + 100).alias("compute_ms"))


_CONSTANTS = _READINGS + """
, speed AS (SELECT profile, median(ms % 400 + 100) AS ms FROM rd GROUP BY 1),
st AS (SELECT family, profile, count(*) AS readings,
         CASE WHEN family = 'constant_op' THEN CAST(floor(median(rate)) AS BIGINT) ELSE min(rate) END
           AS value, max(rate) AS hi, min(rate) FILTER (WHERE rate > 0) AS lo,
         count(*) FILTER (WHERE rate > 0) AS pos FROM rate GROUP BY 1, 2),
pc AS (SELECT family, st.profile, readings, value,
         CASE WHEN pos < 2 THEN 0 ELSE CAST(ceil(10.0::DOUBLE * hi / lo) AS BIGINT) END AS within_spread,
         s.ms / a.ms AS factor, CASE WHEN family = 'constant_op' THEN value / (s.ms / a.ms)
         ELSE value * (s.ms / a.ms) END AS scaled
       FROM st JOIN speed s ON s.profile = st.profile
       CROSS JOIN (SELECT ms FROM speed WHERE profile = 'A-O') a)
"""


@query("profile_constants", _CONSTANTS + """
SELECT family, profile, readings, value, within_spread, CAST(round(factor * 100000) AS BIGINT) AS factor_e5,
       CAST(round(scaled) AS BIGINT) AS scaled FROM pc""")
def profile_constants(spark, sf):
    return me.profile_constants(readings(spark, sf), probes(spark, sf), "A-O").select(
        "family", "profile", "readings", "value", "within_spread",
        F.round(F.col("factor") * 100000).cast("bigint").alias("factor_e5"),
        F.round("scaled").cast("bigint").alias("scaled"))


@query("derived_constants", _CONSTANTS + """
SELECT family, count(*) AS profiles, max(value) FILTER (WHERE profile = 'A-O') AS anchor_value,
  CAST(ceil(10.0::DOUBLE * max(value) / min(value)) AS BIGINT) AS cross_spread_raw,
  CAST(ceil(10.0::DOUBLE * max(scaled) / min(scaled)) AS BIGINT) AS cross_spread_scaled,
  max(within_spread) AS within_spread_max FROM pc GROUP BY family""")
def derived_constants(spark, sf):
    return me.derive_constants(me.profile_constants(
        readings(spark, sf), probes(spark, sf), "A-O"), "A-O")


@query("probe_medians", """
SELECT l_returnflag || '-' || l_linestatus AS profile,
       median(CAST(floor(l_extendedprice) AS BIGINT) % 400 + 100) AS compute_ms
FROM lineitem GROUP BY 1""")
def probe_medians(spark, sf):
    return me.probe_medians(probes(spark, sf))


def cases(spark, sf) -> DataFrame:
    """Scale cases: one per order, at four table sizes."""
    k, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("bigint")
    low = price % 1000 + 1
    return table(spark, sf, "orders").select(
        F.concat(F.lit("case"), (k / 4).cast("bigint").cast("string")).alias("case_id"),
        pick(SIZES, k % 4).alias("table"),
        F.element_at(F.array(*[F.lit(10 ** (3 + 2 * i)) for i in range(4)]),
                     (k % 4 + 1).cast("int")).cast("bigint").alias("size"),
        pick(["safe", "needs_timing", "unsafe", "safe_irreversible"],
             (k * 7 + F.col("o_custkey")) % 4).alias("tier"),
        low.alias("low_ms"), (low * (F.col("o_custkey") % 30 + 2)).alias("high_ms"),
        F.when(k % 17 != 0, price % 30000).alias("measured_ms"), (k % 19 == 0).alias("error"),
        pick(FAMILIES, F.col("o_custkey") % 5).alias("family"),
        (k % 9).cast("int").alias("predicted_level"),
        F.when(k % 6 != 0, (F.col("o_custkey") % 9).cast("int")).alias("measured_level"),
        F.when(k % 5 != 0, price % 5000).alias("rate"))


_CASES = f"""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(floor(o_totalprice) AS BIGINT) AS price
           FROM orders),
cs AS (SELECT k, 'case' || CAST(k // 4 AS VARCHAR) AS case_id, {pick_sql(SIZES, "k % 4")} AS table_,
    k % 4 AS size_no, (['safe', 'needs_timing', 'unsafe', 'safe_irreversible'])[(k * 7 + c) % 4 + 1]
      AS tier, price % 1000 + 1 AS low_ms, (price % 1000 + 1) * (c % 30 + 2) AS high_ms,
    CASE WHEN k % 17 <> 0 THEN price % 30000 END AS measured, k % 19 = 0 AS error,
    {pick_sql(FAMILIES, "c % 5")} AS family, k % 9 AS p_level,
    CASE WHEN k % 6 <> 0 THEN c % 9 END AS m_level, CASE WHEN k % 5 <> 0 THEN price % 5000 END AS rate
  FROM o),
cov AS (SELECT *, CASE WHEN error THEN 'ERR' WHEN measured IS NULL THEN '-' WHEN measured < low_ms
    THEN 'LOW' WHEN measured > high_ms THEN 'HIGH' ELSE 'IN' END AS status FROM cs)
"""


@query("interval_coverage", _CASES + """
, w AS (SELECT high_ms / CAST(greatest(low_ms, 1) AS DOUBLE) AS width,
               high_ms / CAST(greatest(measured, 1) AS DOUBLE) AS over_, status FROM cov
        WHERE status IN ('IN', 'LOW', 'HIGH'))
SELECT count(*) FILTER (WHERE status = 'IN') AS inside, count(*) FILTER (WHERE status = 'LOW') AS below,
  count(*) FILTER (WHERE status = 'HIGH') AS above, round(median(width), 6) AS median_width,
  round(median(over_), 6) AS median_over,
  round((SELECT over_ FROM (SELECT over_, row_number() OVER (ORDER BY over_) - 1 AS p FROM w)
   WHERE p = (SELECT CAST(floor(count(*) * 0.9) AS BIGINT) FROM w)), 6) AS p90_over FROM w""")
def interval_coverage(spark, sf):
    out = me.interval_coverage(cases(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("median_width", "median_over", "p90_over")})


@query("best_durations", """
SELECT l_orderkey, max(CAST(floor(l_extendedprice) AS BIGINT)) AS high_ms,
       arg_max(l_linenumber, {'h': CAST(floor(l_extendedprice) AS BIGINT), 'p': -l_linenumber})
         AS line_no FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey""")
def best_durations(spark, sf):
    parts = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("part_pos"),
        F.lit(1).alias("low_ms"), F.lit(2).alias("point_ms"),
        F.when(F.col("l_returnflag") != "N", F.floor("l_extendedprice").cast("bigint")).alias(
            "high_ms"), F.col("l_linenumber").alias("constant_key"))
    return me.best_duration(parts, ["l_orderkey"]).select(
        "l_orderkey", "high_ms", F.col("constant_key").alias("line_no"))


@query("size_distribution", _CASES + """
SELECT tier, count(*) FILTER (WHERE table_ = 't_1k') AS t_1k,
  count(*) FILTER (WHERE table_ = 't_100k') AS t_100k, count(*) FILTER (WHERE table_ = 't_1m') AS t_1m,
  count(*) FILTER (WHERE table_ = 't_10m') AS t_10m FROM cs GROUP BY tier""")
def size_distribution(spark, sf):
    return me.size_distribution(cases(spark, sf), SIZES)


@query("case_grid", _CASES + """
SELECT case_id, max(tier) FILTER (WHERE table_ = 't_1k') AS t_1k,
  max(tier) FILTER (WHERE table_ = 't_100k') AS t_100k, max(tier) FILTER (WHERE table_ = 't_1m') AS t_1m,
  max(tier) FILTER (WHERE table_ = 't_10m') AS t_10m FROM cs GROUP BY case_id""")
def case_grid(spark, sf):
    return me.case_grid(cases(spark, sf), SIZES)


@query("guess_vs_measured", _CASES + """
SELECT family, count(*) AS samples, count(*) FILTER (WHERE table_ IN ('t_1m', 't_10m')) AS large_samples,
  coalesce(median(rate) FILTER (WHERE table_ IN ('t_1m', 't_10m')), median(rate)) AS median_rate
FROM cs WHERE rate IS NOT NULL GROUP BY family""")
def guess_vs_measured(spark, sf):
    return me.guess_vs_measured(cases(spark, sf), ["t_1m", "t_10m"])


@query("lock_mode_mismatches", _CASES + """
SELECT case_id, table_ AS table_name, p_level AS predicted_level, m_level AS measured_level FROM cs
WHERE m_level <> p_level""")
def lock_mode_mismatches(spark, sf):
    return me.lock_mismatches(cases(spark, sf)).select(
        "case_id", F.col("table").alias("table_name"), "predicted_level", "measured_level")


@query("boundary_crossings", _CASES + """
, m AS (SELECT *, CASE WHEN measured < low_ms THEN 'LOW' ELSE 'HIGH' END AS st,
    CASE WHEN measured < CASE WHEN p_level = 8 THEN 2000 ELSE 5000 END THEN
           CASE WHEN p_level = 8 THEN 'needs_timing' ELSE 'safe' END
         WHEN measured < CASE WHEN p_level = 8 THEN 20000 ELSE 60000 END THEN 'needs_timing'
         ELSE 'unsafe' END AS mt FROM cs
  WHERE measured IS NOT NULL AND (measured < low_ms OR measured > high_ms)),
d AS (SELECT *, CASE mt WHEN 'safe' THEN 0 WHEN 'needs_timing' THEN 1 ELSE 2 END
    - CASE tier WHEN 'needs_timing' THEN 1 WHEN 'unsafe' THEN 2 ELSE 0 END AS delta FROM m)
SELECT st AS status, tier, mt AS measured_tier, delta <> 0 AS crosses, delta > 0 AS dangerous,
       count(*) AS n FROM d GROUP BY 1, 2, 3, 4, 5""")
def boundary_crossings(spark, sf):
    return me.boundary_crossings(cases(spark, sf)).groupBy(
        "status", "tier", "measured_tier", "crosses", "dangerous").agg(F.count("*").alias("n"))


@query("non_monotone_cases", _CASES + """
, r AS (SELECT case_id, size_no, max(CASE tier WHEN 'safe' THEN 0 WHEN 'safe_irreversible' THEN 1
          WHEN 'needs_timing' THEN 2 WHEN 'unknown' THEN 3 ELSE 4 END) AS rank_
        FROM cs GROUP BY 1, 2)
SELECT DISTINCT case_id FROM (SELECT case_id, rank_ < lag(rank_) OVER (PARTITION BY case_id
  ORDER BY size_no) AS softer FROM r) WHERE softer""")
def non_monotone_cases(spark, sf):
    return me.non_monotone_cases(cases(spark, sf))


# --- comparison of runs -----------------------------------------------------------
def run(spark, sf, new: bool) -> DataFrame:
    """One run over the event corpus; each run misses some statements."""
    i, u = F.col("event_id"), F.col("user_id")
    e = table(spark, sf, "events")
    kept = e.filter("event_id % 13 <> 5" if new else "event_id % 11 <> 3")
    tier = pick(TIERS, (i + u) % 5 if new else i % 5)
    return kept.select(u.alias("file_id"), i.alias("idx"), F.col("event_type").alias("kind"),
                       tier.alias("tier"))


_RUNS = f"""
WITH a AS (SELECT user_id AS file_id, event_id AS idx, event_type AS kind,
             {pick_sql(TIERS, "event_id % 5")} AS tier FROM events WHERE event_id % 11 <> 3),
b AS (SELECT user_id AS file_id, event_id AS idx,
             {pick_sql(TIERS, "(event_id + user_id) % 5")} AS tier FROM events
      WHERE event_id % 13 <> 5),
p AS (SELECT a.file_id, a.idx, a.kind, a.tier AS old_tier, b.tier AS new_tier
      FROM a JOIN b USING (file_id, idx))
"""


def pairs(spark, sf) -> DataFrame:
    return cm.paired(run(spark, sf, False), run(spark, sf, True), ["file_id", "idx"])


@query("run_key_overlap", _RUNS + """
SELECT count(*) FILTER (WHERE b.idx IS NULL) AS only_old,
       count(*) FILTER (WHERE a.idx IS NULL) AS only_new,
       count(*) FILTER (WHERE a.idx IS NOT NULL AND b.idx IS NOT NULL) AS shared
FROM a FULL OUTER JOIN b ON a.file_id = b.file_id AND a.idx = b.idx""")
def run_key_overlap(spark, sf):
    return cm.key_overlap(run(spark, sf, False), run(spark, sf, True), ["file_id", "idx"])


@query("tier_movement", _RUNS + """
SELECT old_tier, new_tier, count(*) AS n FROM p GROUP BY 1, 2""")
def tier_movement(spark, sf):
    return cm.movement_matrix(pairs(spark, sf))


@query("movement_kinds", _RUNS + """
SELECT old_tier, new_tier, kind, n, place FROM (SELECT old_tier, new_tier, kind, count(*) AS n,
  row_number() OVER (PARTITION BY old_tier, new_tier ORDER BY count(*) DESC, kind) AS place
  FROM p WHERE old_tier <> new_tier GROUP BY 1, 2, 3) WHERE place <= 8""")
def movement_kinds(spark, sf):
    return cm.movement_kinds(pairs(spark, sf))


@query("safety_checks", _RUNS + """
SELECT count(*) FILTER (WHERE old_tier = 'unsafe') AS old_unsafe,
  count(*) FILTER (WHERE new_tier = 'unsafe') AS new_unsafe,
  count(*) FILTER (WHERE old_tier = 'unsafe' AND new_tier LIKE 'safe%') AS violations,
  count(*) FILTER (WHERE old_tier = 'unsafe' AND new_tier <> 'unsafe') AS softened,
  count(*) FILTER (WHERE old_tier <> 'unsafe' AND new_tier = 'unsafe') AS hardened FROM p""")
def safety_checks(spark, sf):
    return cm.safety_checks(pairs(spark, sf))


@query("unsafe_moves", _RUNS + """
SELECT file_id, idx, kind, CASE WHEN old_tier = 'unsafe' THEN CASE WHEN new_tier LIKE 'safe%'
  THEN 'violation' ELSE 'softened' END ELSE 'hardened' END AS move
FROM p WHERE (old_tier = 'unsafe') <> (new_tier = 'unsafe')""")
def unsafe_moves(spark, sf):
    return cm.moves(pairs(spark, sf)).select("file_id", "idx", "kind", "move")


@query("coverage_changes", _CASES + """
, n AS (SELECT *, CASE WHEN k % 23 = 0 THEN 'ERR' WHEN measured IS NULL THEN '-'
    WHEN measured < low_ms // 2 THEN 'LOW' WHEN measured > high_ms * 2 THEN 'HIGH' ELSE 'IN' END
    AS now FROM cs WHERE k % 7 <> 1)
SELECT coalesce(o.case_id, n.case_id) AS case_id, coalesce(o.table_, n.table_) AS table_name,
       status AS was, now FROM cov o FULL OUTER JOIN n ON n.case_id = o.case_id AND n.table_ = o.table_
WHERE status IS DISTINCT FROM now""")
def coverage_changes(spark, sf):
    old = cases(spark, sf)
    raw = table(spark, sf, "orders").filter("o_orderkey % 7 <> 1").select(
        F.concat(F.lit("case"), (F.col("o_orderkey") / 4).cast("bigint").cast("string")
                 ).alias("case_id"), pick(SIZES, F.col("o_orderkey") % 4).alias("table"),
        (F.col("o_orderkey") % 23 == 0).alias("new_error"))
    new = old.join(raw, ["case_id", "table"]).select(
        "case_id", "table", F.floor(F.col("low_ms") / 2).cast("bigint").alias("low_ms"),
        (F.col("high_ms") * 2).alias("high_ms"), "measured_ms",
        F.col("new_error").alias("error"))
    return cm.coverage_changes(old, new, ["case_id", "table"]).withColumnRenamed(
        "table", "table_name")


@query("moves_into_tier", _RUNS + """
SELECT file_id, idx, kind, old_tier FROM p
WHERE new_tier = 'safe_irreversible' AND old_tier <> 'safe_irreversible'
  AND kind IN ('purchase', 'signup')""")
def moves_into_tier(spark, sf):
    return cm.moves_into(pairs(spark, sf), "safe_irreversible", ["purchase", "signup"]).select(
        "file_id", "idx", "kind", "old_tier")


@query("document_changes", """
WITH d AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_custkey % 4 AS n FROM orders)
SELECT k AS doc, '.a.status' AS path, 'changed' AS change FROM d WHERE s = 'F'
UNION ALL SELECT k, '.list', 'length' FROM d WHERE n = 1
UNION ALL SELECT k, '.list[1].x', 'changed' FROM d WHERE n = 2
UNION ALL SELECT k, '.extra', 'added' FROM d WHERE n = 3
UNION ALL SELECT k, '.gone', 'removed' FROM d WHERE k % 3 = 0""")
def document_changes(spark, sf):
    k, n = F.col("o_orderkey"), F.col("o_custkey") % 4

    def document(new: bool):
        status = F.when((F.col("o_orderstatus") == "F") & F.lit(new), "X").otherwise(
            F.col("o_orderstatus"))
        second = F.when((n == 2) & F.lit(new), '{"x":2}').otherwise('{"x":1}')
        third = F.when((n == 1) & F.lit(new), ",3").otherwise("")
        extra = F.when((n == 3) & F.lit(new), ',"extra":{"y":[1]}').otherwise("")
        gone = F.when((k % 3 == 0) & F.lit(not new), ',"gone":null').otherwise("")
        stamp = F.lit(',"path":"/new"' if new else ',"path":"/old"')
        return F.concat(F.lit('{"a":{"status":"'), status, F.lit('"},"list":[1,'), second, third,
                        F.lit("]"), extra, gone, stamp, F.lit("}"))

    orders = table(spark, sf, "orders")
    left = orders.select(k.alias("doc"), document(False).alias("body"))
    right = orders.select(k.alias("doc"), document(True).alias("body"))
    return cm.document_changes(left, right, ["doc"], "body", volatile=["path"]).select(
        "doc", "path", "change")


_TIERS_ONLY = " SELECT file_id, idx, tier FROM statement_verdicts"


@query("reassessed_with_other_rates", f"""
SELECT a.tier AS old_tier, b.tier AS new_tier, count(*) AS n
FROM ({assessment(True)}{_TIERS_ONLY}) a JOIN ({assessment(True, slower=2)}{_TIERS_ONLY}) b
  ON a.file_id = b.file_id AND a.idx = b.idx GROUP BY 1, 2""")
def reassessed_with_other_rates(spark, sf):
    """The corpus assessed again with every rate halved, as a movement matrix."""
    from changerisk.functions.durations import RateTable
    from changerisk.plans.assess import assess
    from changerisk.workload.verdicts import flat, snapshot, written

    slower = RateTable([{**r, "value": max(1, r["value"] // 2)} if r["unit"] != "ms" else r
                        for r in tables.rate_rows()])
    again = assess(adapters.statements(spark, sf), snapshot(spark, sf), rates=slower)
    return cm.movement_matrix(cm.paired(flat(written(spark, sf, True)), flat(again),
                                        ["file_id", "idx"]))
