"""The duration model over relation facts derived from order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changerisk.functions import durations as du
from changerisk.functions.facts import known, unavailable
from changerisk.seeds import tables
from changerisk.workload import adapters
from changerisk.workload.adapters import table
from changerisk.workload.registry import query
from changerisk.workload.sqltext import CORPUS, RELATION_STATS, SERVERS, UNITS, cte, value

FAMILIES = [r["key"] for r in tables.rate_rows() if r["unit"] == "rows/s"]

# Facts as the adapter hands them over: usable rows, widening and factor per relation.
SIZED = """
facts AS (
  SELECT s.db_id, relation, r, bytes,
         CASE WHEN r = 2 AND s.db_id = 3 THEN NULL ELSE row_count END AS rows_, mods, age_days,
         r = 5 AS mods_masked, r = 6 AS never
  FROM relation_stats s),
sized AS (
  SELECT *, CASE WHEN never OR age_days > 30 THEN 30 WHEN age_days <= 1 THEN 10
                 WHEN age_days <= 7 THEN 15 ELSE 20 END AS age_tenths,
         CASE WHEN mods_masked THEN 20
              ELSE least(50, 10 + 10 * mods // greatest(rows_, 1)) END AS mods_tenths,
         rows_ IS NULL AS unsized,
         NOT mods_masked AND mods > 0 AND rows_ < mods // 10 AS swamped
  FROM facts),
factors AS (
  SELECT db_id, pg_version, least(80, greatest(3, CAST(round_even(
           10.0 * greatest(2, probe_ms) / 215, 0) AS BIGINT))) AS factor FROM servers),
rates(family, rate, widen) AS (VALUES """ + ", ".join(
    f"('{r['key']}', {r['value']}, "
    f"{40 if r['calibration'] == 'uncalibrated' else min(max(r['spread'], 15), 20)})"
    for r in tables.rate_rows()) + """)
"""


def sized_relations(spark, sf) -> DataFrame:
    relations = adapters.relations(spark, sf)
    servers = adapters.servers(spark, sf)
    return du.with_sizing(relations.join(F.broadcast(servers), "db_id"))


@query("relation_staleness", cte(RELATION_STATS, SERVERS, SIZED) + """
SELECT db_id, relation, coalesce(rows_, -1) AS usable_rows, age_tenths,
       CASE WHEN unsized OR swamped THEN -1 ELSE mods_tenths END AS mods_tenths,
       CASE WHEN unsized OR swamped THEN -1 ELSE age_tenths * mods_tenths // 10 END AS stale_tenths
FROM sized""")
def relation_staleness(spark, sf):
    joined = sized_relations(spark, sf)
    rows = du.usable_rows(F.col("facts"))["rows"]
    mods = du.mods_widen(F.col("facts"), rows)
    refused = rows.isNull() | mods["refusal"].isNotNull()
    return joined.select(
        "db_id", "relation", F.coalesce(rows, F.lit(-1)).alias("usable_rows"),
        du.age_widen(F.col("facts"), F.col("server_now")).alias("age_tenths"),
        F.when(refused, -1).otherwise(mods["tenths"]).alias("mods_tenths"),
        F.when(refused, -1).otherwise(F.col("sizing.stale")).alias("stale_tenths"))


@query("usable_row_refusals", """
WITH p AS (SELECT p_partkey, p_size, p_partkey % 5 AS f FROM part)
SELECT p_partkey, CASE WHEN f IN (1, 2) OR (f = 3 AND p_size % 4 = 0) OR f = 4
                       THEN -1 ELSE p_size % 4 * 10 END AS usable_rows
FROM p""")
def usable_row_refusals(spark, sf):
    key, size = F.col("p_partkey") % 5, F.col("p_size") % 4 * 10
    time = F.lit(None).cast("timestamp")
    masked = unavailable(F.lit("masked"), "timestamp")
    facts = F.struct(
        F.when(key == 1, unavailable(F.lit("timeout"), "boolean")).otherwise(
            known(key != 2)).alias("exists"),
        F.when(key == 4, unavailable(F.lit("reltuples is -1"), "bigint")).otherwise(
            known(size.cast("bigint"))).alias("reltuples"),
        F.when(key == 3, known(time)).otherwise(masked).alias("last_analyze"),
        known(time).alias("last_autoanalyze"))
    return table(spark, sf, "part").select("p_partkey", F.coalesce(
        du.usable_rows(facts)["rows"], F.lit(-1)).alias("usable_rows"))


@query("rate_widening", """
WITH r AS (SELECT l_suppkey % 7 AS family, l_returnflag AS flag, count(*) % 4 AS runs,
                  10 + CAST(sum(l_quantity) AS BIGINT) % 30 AS spread,
                  count(*) % 6 AS profiles, CAST(sum(l_quantity) AS BIGINT) % 40 AS cross_spread
           FROM lineitem GROUP BY 1, 2)
SELECT family, flag, CASE WHEN flag = 'A' THEN 40 WHEN flag = 'N' THEN 15 WHEN runs < 2 THEN 30
                          ELSE least(greatest(spread, 15), 20) END AS widen_tenths,
       CASE WHEN flag = 'A' THEN 40 ELSE greatest(15, CASE WHEN profiles >= 3 THEN cross_spread
            ELSE 0 END) END AS boundary_tenths FROM r""")
def rate_widening(spark, sf):
    li = table(spark, sf, "lineitem")
    qty = F.sum("l_quantity").cast("bigint")
    rates = li.groupBy((F.col("l_suppkey") % 7).alias("family"),
                       F.col("l_returnflag").alias("flag")).agg(
        (F.count("*") % 4).alias("runs"), (qty % 30 + 10).alias("spread"),
        (F.count("*") % 6).alias("profiles"), (qty % 40).alias("cross_spread"))
    calibration = F.when(F.col("flag") == "A", "uncalibrated").when(
        F.col("flag") == "N", "calibrated").otherwise("measured")
    return rates.select(
        "family", "flag",
        du.base_widen(calibration, F.col("runs"), F.col("spread")).alias("widen_tenths"),
        du.boundary_spread(calibration, F.col("profiles"), F.col("cross_spread")
                           ).alias("boundary_tenths"))


@query("hardware_factors", """
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 10 ELSE least(80, greatest(3, CAST(round_even(
  10.0 * greatest(2, CAST(floor(value * 8) AS BIGINT)) / 215, 0) AS BIGINT))) END AS factor_tenths
FROM events""")
def hardware_factors(spark, sf):
    probe = F.when(F.col("event_id") % 10 == 0, unavailable(F.lit("timeout"), "bigint")
                   ).otherwise(known(F.floor(F.col("value") * 8).cast("bigint")))
    return table(spark, sf, "events").select("event_id", du.hardware_factor(probe).alias(
        "factor_tenths"))


_PROPORTIONAL = """
  point + 10 AS point_ms, point * 10 // total + 1 AS low_ms,
  greatest(point * total // 10, point) + 100 AS high_ms,
  CASE WHEN total <= 20 THEN 'high' WHEN total <= 60 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN greatest(point * total // 10, point) + 100 < 1000 THEN 'sub_second'
       WHEN greatest(point * total // 10, point) + 100 < 60000 THEN 'seconds'
       WHEN greatest(point * total // 10, point) + 100 < 3600000 THEN 'minutes' ELSE 'long' END
    AS band
"""


def _flat(estimate: str) -> list:
    e = F.col(estimate)
    return [F.coalesce(e[n], F.lit(-1)).alias(n) for n in ("point_ms", "low_ms", "high_ms")] + [
        F.coalesce(e["confidence"], F.lit("none")).alias("confidence"),
        F.coalesce(du.band(e["high_ms"]), F.lit("none")).alias("band")]


@query("row_estimates", cte(RELATION_STATS, SERVERS, SIZED) + f"""
, e AS (
  SELECT s.db_id, s.relation, x.family, unsized OR coalesce(swamped, false) AS refused,
         rows_ * 1000 // x.rate * factor // 10 AS point,
         x.widen * (age_tenths * mods_tenths // 10) // 10 AS total
  FROM sized s JOIN factors USING (db_id)
  JOIN rates x ON x.family IN {tuple(FAMILIES)})
SELECT db_id, relation, family, {_PROPORTIONAL.strip()} FROM e WHERE NOT refused
UNION ALL SELECT db_id, relation, family, -1, -1, -1, 'none', 'none' FROM e WHERE refused""")
def row_estimates(spark, sf):
    families = F.explode(F.array(*[F.lit(f) for f in FAMILIES])).alias("family")
    rows = sized_relations(spark, sf).select("db_id", "relation", "sizing", families)
    return rows.withColumn("e", du.estimate_rows(
        F.col("sizing"), F.col("family"), du.RateTable())).select(
        "db_id", "relation", "family", *_flat("e"))


@query("rebuild_estimates", cte(RELATION_STATS, SERVERS, SIZED) + f"""
, e AS (
  SELECT s.db_id, s.relation, unsized OR coalesce(swamped, false) AS refused,
         CASE WHEN r % 2 = 0 THEN 'index_build_btree' ELSE 'index_build_expression' END AS slow,
         (rows_ * 1000 // 740000 + CASE WHEN r % 2 = 1 THEN rows_ * 1000 // 170000 ELSE 0 END)
           * factor // 10 AS point,
         (CASE WHEN r % 2 = 1 THEN greatest(20, 15) ELSE 20 END)
           * (age_tenths * mods_tenths // 10) // 10 AS total
  FROM sized s JOIN factors USING (db_id))
SELECT db_id, relation, CASE WHEN rows_zero THEN 'index_build_btree' ELSE slow END AS constant_key,
       {_PROPORTIONAL.strip()} FROM (SELECT *, point = 0 AND false AS rows_zero FROM e)
WHERE NOT refused
UNION ALL SELECT db_id, relation, 'none', -1, -1, -1, 'none', 'none' FROM e WHERE refused""")
def rebuild_estimates(spark, sf):
    odd = F.substr("relation", F.lit(2)).cast("int") % 2 == 1
    families = F.when(odd, F.array(F.lit("index_build_btree"), F.lit("index_build_expression"))
                      ).otherwise(F.array(F.lit("index_build_btree")))
    rows = sized_relations(spark, sf).withColumn("e", du.estimate_rebuilds(
        F.col("sizing"), families, du.RateTable()))
    return rows.select("db_id", "relation", F.coalesce("e.constant_key", F.lit("none")
                                                       ).alias("constant_key"), *_flat("e"))


@query("byte_estimates", cte(RELATION_STATS, SERVERS, SIZED) + f"""
, e AS (SELECT s.db_id, s.relation, bytes * 1000 // 7800000 * factor // 10 AS point, 15 AS total
        FROM sized s JOIN factors USING (db_id))
SELECT db_id, relation, {_PROPORTIONAL.strip()} FROM e""")
def byte_estimates(spark, sf):
    rows = sized_relations(spark, sf).withColumn("e", du.estimate_bytes(
        F.col("facts.size_bytes.value"), F.col("sizing.factor"), F.lit("index_bytes"),
        du.RateTable()))
    return rows.select("db_id", "relation", *_flat("e"))


_FAMILY_PAIRS = [{"k": k, "f": f} for k, f in tables.rows_family().items()]


@query("duration_families", cte(CORPUS, UNITS) + f"""
, fam AS (SELECT x.k, x.f FROM (SELECT unnest({value(_FAMILY_PAIRS)}) AS x))
SELECT file_id, idx, inner_pos, action_pos, CASE
  WHEN f = 'index_build_btree' AND ukind IN ('create_index', 'create_index_concurrently')
       AND (index_method <> 'btree' OR has_expression) THEN 'index_build_expression'
  ELSE f END AS rows_family,
  CASE WHEN ukind IN ('reindex', 'reindex_concurrently') THEN 'index_bytes' END AS bytes_family
FROM units LEFT JOIN fam ON k = ukind""")
def duration_families(spark, sf):
    from changerisk.operators.rules import explode_units

    units = explode_units(adapters.statements(spark, sf))
    return units.select(
        "file_id", "idx", "inner_pos", "action_pos",
        du.rows_family(F.col("kind"), F.col("index_method"), F.col("has_expression")
                       ).alias("rows_family"),
        du.bytes_family(F.col("kind")).alias("bytes_family"))


@query("fixed_cost_bands", """
SELECT event_id, CASE WHEN h < 1000 THEN 'sub_second' WHEN h < 60000 THEN 'seconds'
  WHEN h < 3600000 THEN 'minutes' ELSE 'long' END AS band,
  CASE WHEN w <= 20 THEN 'high' WHEN w <= 60 THEN 'medium' ELSE 'low' END AS confidence,
  10 AS point_ms, 1 AS low_ms, 100 AS high_ms
FROM (SELECT event_id, CAST(floor(value * 10000) AS BIGINT) AS h, event_id % 90 AS w FROM events)
""")
def fixed_cost_bands(spark, sf):
    fixed = du.fixed_cost("proven")
    return table(spark, sf, "events").select(
        "event_id", du.band(F.floor(F.col("value") * 10000)).alias("band"),
        du.confidence(F.col("event_id") % 90).alias("confidence"),
        fixed["point_ms"].alias("point_ms"), fixed["low_ms"].alias("low_ms"),
        fixed["high_ms"].alias("high_ms"))


