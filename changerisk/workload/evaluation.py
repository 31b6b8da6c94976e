"""Scoring predictions against measured truth, and machine factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changerisk.operators import evaluate as ev
from changerisk.seeds import tables
from changerisk.workload import adapters
from changerisk.workload.adapters import pick, pick_sql, table
from changerisk.workload.registry import query
from changerisk.workload.verdictsql import assessment

TIERS = list(tables.TIERS)
KINDS = ["create_index", "update", "alter_table", "delete", "vacuum", "insert"]
KEYS = [r["key"] for r in tables.rate_rows()][:9] + [None]
CLASSES = [None, "looks_benign", "looks_dangerous"]


def results(spark, sf) -> DataFrame:
    """Measured statements: one per event, scored with a machine factor."""
    i, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    return table(spark, sf, "events").select(
        (i / 4).cast("bigint").cast("string").alias("case_id"), (i % 4).alias("idx"),
        F.concat(F.lit("family"), (u % 10).cast("string")).alias("family"),
        pick(CLASSES, i % 3).alias("adversarial"), pick(KINDS, i % 6).alias("kind"),
        pick(TIERS, (i + u) % 5).alias("predicted"),
        F.when((i + u) % 5 == 3, F.when(u % 2 == 0, "boundary")).alias("refusal"),
        F.when((i + u) % 5 == 3, F.when(u % 2 == 0, pick(["safe", "needs_timing", "unsafe"],
                                                         i % 3))).alias("refused_from"),
        pick(KINDS, u % 6).alias("deciding_kind"), pick(KEYS, i % 10).alias("constant_key"),
        (F.floor(v * 150)).cast("bigint").alias("high_ms"), (i % 23 == 0).alias("error"),
        F.when(i % 9 != 0, (i % 9).cast("int")).alias("level"),
        F.floor(v * 100).cast("bigint").alias("work_ms"), (i % 50).alias("wait_ms"),
        F.floor(v * 110).cast("bigint").alias("wall_ms"), (i % 2 == 0).alias("is_dml"),
        (u % 3).alias("rows_touched"), (u % 4 == 0).alias("irreversible"),
        F.lit(2.0).alias("factor"), F.when(u % 3 != 0, F.lit(0.5)).alias("family_factor"),
        (i % 5 == 0).alias("probe_scaled"), pick(TIERS, i % 5).alias("expected_tier"),
        (i % 9).cast("int").alias("expected_level"), (i % 4 == 0).alias("expected_rewrite"),
        F.when(i % 6 != 0, i % 3 == 0).alias("rewrote"), (i % 46 == 0).alias("expected_error"))


def scored(spark, sf) -> DataFrame:
    return ev.label_results(results(spark, sf))


def _label(name: str, hold: str) -> str:
    return f"""
  CASE WHEN error THEN 'unsafe' WHEN blk = 'none' AND NOT rowlevel THEN
      CASE WHEN irreversible THEN 'safe_irreversible' ELSE 'safe' END
    WHEN {hold} < short_ THEN CASE WHEN blk = 'reads' THEN 'needs_timing'
      WHEN irreversible THEN 'safe_irreversible' ELSE 'safe' END
    WHEN {hold} < long_ THEN 'needs_timing' ELSE 'unsafe' END AS {name}"""


def _outcome(predicted: str, truth: str) -> str:
    rank = "CASE {0} WHEN 'safe' THEN 0 WHEN 'safe_irreversible' THEN 1 " \
           "WHEN 'needs_timing' THEN 2 ELSE 3 END"
    return (f"CASE WHEN {predicted} = 'unknown' THEN 'unknown' WHEN {predicted} = {truth} THEN "
            f"'match' WHEN {rank.format(predicted)} < {rank.format(truth)} THEN 'lenient' "
            "ELSE 'strict' END")


_SCORED = f"""
WITH res AS (
  SELECT event_id AS i, CAST(event_id // 4 AS VARCHAR) AS case_id, event_id % 4 AS idx, user_id AS u,
    'family' || CAST(user_id % 10 AS VARCHAR) AS family, {pick_sql(CLASSES, "event_id % 3")}
    AS adversarial, {pick_sql(KINDS, "event_id % 6")} AS kind,
    {pick_sql(TIERS, "(event_id + user_id) % 5")} AS predicted,
    (event_id + user_id) % 5 = 3 AND user_id % 2 = 0 AS refused,
    (['safe', 'needs_timing', 'unsafe'])[event_id % 3 + 1] AS refused_from,
    {pick_sql(KINDS, "user_id % 6")} AS deciding_kind, {pick_sql(KEYS, "event_id % 10")}
    AS constant_key, CAST(floor(value * 150) AS BIGINT) AS high_ms, event_id % 23 = 0 AS error,
    event_id % 9 AS level, CAST(floor(value * 100) AS BIGINT) AS work, event_id % 50 AS wait,
    CAST(floor(value * 110) AS BIGINT) AS wall_ms, user_id % 4 = 0 AS irreversible,
    event_id % 5 = 0 AS probe_scaled, event_id % 2 = 0 AND user_id % 3 > 0 AS wrote
  FROM events),
b AS (
  SELECT *, CASE WHEN level = 8 THEN 'reads' WHEN level BETWEEN 5 AND 7 THEN 'writes'
            ELSE 'none' END AS blk, level IN (2, 3) OR wrote AS rowlevel,
    CASE WHEN level = 8 THEN 2000 ELSE 5000 END AS short_,
    CASE WHEN level = 8 THEN 20000 ELSE 60000 END AS long_, work + wait AS h_raw,
    CAST(round_even(work / 2.0, 0) AS BIGINT) + wait AS h_norm, work * 2 + wait AS h_fam
  FROM res),
l AS (SELECT *, {_label('t_raw', 'h_raw')}, {_label('t_norm', 'h_norm')},
             {_label('t_fam', 'h_fam')} FROM b),
s0 AS (
  SELECT *, CASE WHEN probe_scaled THEN t_raw ELSE t_norm END AS truth,
    CASE WHEN probe_scaled THEN h_raw ELSE h_norm END AS hold_ms FROM l),
s1 AS (
  SELECT *, CASE WHEN error OR (blk = 'none' AND NOT rowlevel) THEN NULL
     WHEN abs(hold_ms - short_) <= abs(hold_ms - long_) THEN hold_ms / CAST(short_ AS DOUBLE)
     ELSE hold_ms / CAST(long_ AS DOUBLE) END AS proximity FROM s0),
sc AS (SELECT *, {_outcome('predicted', 'truth')} AS outcome FROM s1)
"""


@query("truth_labels", _SCORED + """
SELECT case_id, idx, truth, CASE WHEN error THEN 'none' ELSE blk END AS block, hold_ms, outcome,
       t_raw, t_norm, CASE WHEN u % 3 <> 0 THEN t_fam END AS t_family FROM sc""")
def truth_labels(spark, sf):
    return scored(spark, sf).select(
        "case_id", "idx", "truth", "block", "hold_ms", "outcome",
        F.col("truth_raw.tier").alias("t_raw"), F.col("truth_normalized.tier").alias("t_norm"),
        F.col("truth_family.tier").alias("t_family"))


@query("strongest_modes", """
SELECT user_id, max(CASE WHEN event_id % 9 < 8 THEN event_id % 9 + 1 END) AS level
FROM events GROUP BY user_id""")
def strongest_modes(spark, sf):
    samples = table(spark, sf, "events").select(
        "user_id", pick(adapters.WAIT_MODES, F.col("event_id") % 9).alias("mode"))
    return ev.strongest_modes(samples, ["user_id"])


@query("threshold_proximity", _SCORED + """
SELECT case_id, idx, CAST(round(proximity * 1000) AS BIGINT) AS proximity_milli FROM sc
WHERE proximity IS NOT NULL""")
def threshold_proximity(spark, sf):
    return scored(spark, sf).filter(F.col("proximity").isNotNull()).select(
        "case_id", "idx", F.round(F.col("proximity") * 1000).cast("bigint").alias(
            "proximity_milli"))


@query("outcome_counts", _SCORED + "SELECT outcome, count(*) AS n FROM sc GROUP BY outcome")
def outcome_counts(spark, sf):
    return ev.outcome_counts(scored(spark, sf))


@query("expectation_mismatches", _SCORED + f"""
SELECT case_id, idx, concat_ws(',', CASE WHEN {pick_sql(TIERS, 'i % 5')} <> truth THEN 'tier' END,
  CASE WHEN CAST(i % 9 AS INT) IS DISTINCT FROM NULLIF(level, 0) AND NOT (level = 0 AND (error OR
       wall_ms < 30)) THEN 'lock' END,
  CASE WHEN i % 6 <> 0 AND (i % 4 = 0) <> (i % 3 = 0) THEN 'rewrite' END,
  CASE WHEN (i % 46 = 0) <> error THEN 'error' END) AS mismatches FROM sc""")
def expectation_mismatches(spark, sf):
    return ev.expectation_mismatches(scored(spark, sf)).select(
        "case_id", "idx", F.array_join("mismatches", ",").alias("mismatches"))


@query("deciding_parts", assessment(True) + """
SELECT file_id, idx, ukind AS deciding_kind, tier AS predicted,
       coalesce(CASE WHEN branch <> 'matched_dml' AND NOT refused THEN key_ END, '') AS constant_key
FROM (SELECT *, row_number() OVER (PARTITION BY file_id, idx ORDER BY -rank_, inner_pos * 100
      + action_pos) AS p2 FROM ranked WHERE NOT empty) WHERE p2 = 1""")
def deciding_parts(spark, sf):
    from changerisk.workload.verdicts import written

    parts = written(spark, sf, True).parts.filter("NOT empty").select(
        "file_id", "idx", "kind", F.col("verdict.tier").alias("tier"),
        F.col("duration.constant_key").alias("constant_key"),
        F.col("duration.high_ms").alias("high_ms"),
        (F.col("inner_pos") * 100 + F.col("action_pos")).alias("part_pos"))
    return ev.deciding_parts(parts, ["file_id", "idx"]).select(
        "file_id", "idx", "deciding_kind", "predicted",
        F.coalesce("constant_key", F.lit("")).alias("constant_key"))


@query("tier_scores", _SCORED + """
, t AS (SELECT unnest(['safe', 'safe_irreversible', 'needs_timing', 'unsafe']) AS tier)
SELECT tier, count(*) FILTER (WHERE predicted = tier) AS predicted,
  count(*) FILTER (WHERE truth = tier) AS truth,
  count(*) FILTER (WHERE predicted = tier AND truth = tier) AS tp,
  count(*) FILTER (WHERE predicted = tier AND truth <> tier) AS fp,
  count(*) FILTER (WHERE predicted <> tier AND truth = tier) AS fn,
  count(*) FILTER (WHERE predicted = 'unknown' AND truth = tier) AS fn_as_unknown,
  round(count(*) FILTER (WHERE predicted = tier AND truth = tier)
        / CAST(NULLIF(count(*) FILTER (WHERE predicted = tier), 0) AS DOUBLE), 6) AS precision,
  round(count(*) FILTER (WHERE predicted = tier AND truth = tier)
        / CAST(NULLIF(count(*) FILTER (WHERE truth = tier), 0) AS DOUBLE), 6) AS recall
FROM sc CROSS JOIN t GROUP BY tier""")
def tier_scores(spark, sf):
    return ev.tier_scores(scored(spark, sf)).withColumns({
        "precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query("wrong_cases", _SCORED + """
SELECT case_id, idx, predicted, truth, outcome FROM sc WHERE predicted <> truth""")
def wrong_cases(spark, sf):
    return ev.wrong_cases(scored(spark, sf))


@query("confusion_matrix", _SCORED + """
SELECT t.predicted, count(*) FILTER (WHERE truth = 'safe') AS safe,
  count(*) FILTER (WHERE truth = 'safe_irreversible') AS safe_irreversible,
  count(*) FILTER (WHERE truth = 'needs_timing') AS needs_timing,
  count(*) FILTER (WHERE truth = 'unsafe') AS unsafe
FROM (SELECT unnest(['safe', 'safe_irreversible', 'needs_timing', 'unknown', 'unsafe'])
      AS predicted) t LEFT JOIN sc USING (predicted) GROUP BY t.predicted""")
def confusion_matrix(spark, sf):
    return ev.confusion(scored(spark, sf))


@query("error_breakdown", _SCORED + """
, x AS (SELECT unnest([{'b': 'statement_kind', 'k': kind}, {'b': 'deciding_kind', 'k': deciding_kind},
    {'b': 'constant', 'k': coalesce(constant_key, '(no duration constant)')},
    {'b': 'family', 'k': family}, {'b': 'adversarial', 'k': coalesce(adversarial, '(plain)')}]) AS e,
    outcome FROM sc)
SELECT e.b AS breakdown, e.k AS key, count(*) AS total,
  count(*) FILTER (WHERE outcome = 'match') AS match,
  count(*) FILTER (WHERE outcome = 'strict') AS strict,
  count(*) FILTER (WHERE outcome = 'lenient') AS lenient,
  count(*) FILTER (WHERE outcome = 'unknown') AS unknown FROM x GROUP BY 1, 2""")
def error_breakdown(spark, sf):
    return ev.error_breakdown(scored(spark, sf))


_FILES = _SCORED + """
, r AS (SELECT case_id, max(CASE WHEN predicted = 'unsafe' THEN 2 WHEN predicted LIKE 'safe%' THEN 0
         ELSE 1 END) AS p, max(CASE WHEN truth = 'unsafe' THEN 2 WHEN truth LIKE 'safe%' THEN 0
         ELSE 1 END) AS t FROM sc GROUP BY case_id),
f AS (SELECT case_id, (['proceed', 'requires_approval', 'block'])[p + 1] AS predicted,
        (['proceed', 'requires_approval', 'block'])[t + 1] AS truth,
        CASE WHEN p = t THEN 'match' WHEN p < t THEN 'lenient' ELSE 'strict' END AS direction FROM r)
"""


@query("file_scores", _FILES + "SELECT * FROM f")
def file_scores(spark, sf):
    return ev.file_scores(scored(spark, sf))


@query("file_level_scores", _FILES + """
SELECT v AS verdict, count(*) FILTER (WHERE predicted = v) AS predicted,
  count(*) FILTER (WHERE truth = v) AS truth, count(*) FILTER (WHERE predicted = v AND truth = v)
  AS tp, round(count(*) FILTER (WHERE predicted = v AND truth = v)
    / CAST(NULLIF(count(*) FILTER (WHERE predicted = v), 0) AS DOUBLE), 6) AS precision,
  round(count(*) FILTER (WHERE predicted = v AND truth = v)
    / CAST(NULLIF(count(*) FILTER (WHERE truth = v), 0) AS DOUBLE), 6) AS recall
FROM f CROSS JOIN (SELECT unnest(['proceed', 'requires_approval', 'block']) AS v) GROUP BY v""")
def file_level_scores(spark, sf):
    return ev.file_level_scores(ev.file_scores(scored(spark, sf))).withColumns({
        "precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query("boundary_cases", _SCORED + """
SELECT case_id, idx, hold_ms, truth, predicted, outcome FROM sc
WHERE abs(proximity - 1.0) <= 0.25""")
def boundary_cases(spark, sf):
    return ev.boundary_cases(scored(spark, sf)).select("case_id", "idx", "hold_ms", "truth",
                                                       "predicted", "outcome")


@query("refusal_ledger", _SCORED + f"""
SELECT refused_from, truth, {_outcome('refused_from', 'truth')} AS would_have_been, count(*) AS n
FROM sc WHERE refused AND predicted = 'unknown' GROUP BY 1, 2, 3""")
def refusal_ledger(spark, sf):
    return ev.refusal_ledger(scored(spark, sf)).groupBy(
        "refused_from", "truth", "would_have_been").agg(F.count("*").alias("n"))


@query("probe_statistics", """
WITH r AS (SELECT user_id % 20 AS machine, 100 + event_id % 700 AS ms, row_number() OVER (
  PARTITION BY user_id % 20 ORDER BY 100 + event_id % 700) - 1 AS pos, count(*) OVER (
  PARTITION BY user_id % 20) AS n FROM events)
SELECT machine, n, min(ms) AS least, max(CASE WHEN pos = n // 2 THEN ms END) AS upper_median,
       max(ms) AS greatest FROM r GROUP BY 1, 2""")
def probe_statistics(spark, sf):
    readings = table(spark, sf, "events").select(
        (F.col("user_id") % 20).alias("machine"), (F.col("event_id") % 700 + 100).alias("ms"))
    return ev.probe_statistics(readings, ["machine"], "ms")


@query("normalization_sensitivity", _SCORED + f"""
, x AS (SELECT predicted, truth, unnest([{{'v': 'raw', 't': t_raw}}, {{'v': 'normalized', 't': t_norm}},
   {{'v': 'per_family', 't': CASE WHEN u % 3 <> 0 THEN t_fam END}}, {{'v': 'used', 't': truth}}]) AS e
   FROM sc),
y AS (SELECT e.v AS variant, e.t AS label, predicted, truth, {_outcome('predicted', 'e.t')} AS o
      FROM x WHERE e.t IS NOT NULL)
SELECT variant, count(*) AS labelled, count(*) FILTER (WHERE label <> truth) AS flipped,
  count(*) FILTER (WHERE o = 'match') AS match, count(*) FILTER (WHERE o = 'strict') AS strict,
  count(*) FILTER (WHERE o = 'lenient') AS lenient, count(*) FILTER (WHERE o = 'unknown') AS unknown
FROM y GROUP BY variant""")
def normalization_sensitivity(spark, sf):
    return ev.normalization_sensitivity(scored(spark, sf))


@query("evaluation_summary", _SCORED + """
SELECT count(*) AS statements, count(*) FILTER (WHERE error) AS errors,
  count(*) FILTER (WHERE outcome = 'match') AS match,
  count(*) FILTER (WHERE outcome = 'strict') AS strict,
  count(*) FILTER (WHERE outcome = 'lenient') AS lenient,
  count(*) FILTER (WHERE outcome = 'unknown') AS unknown,
  count(*) FILTER (WHERE predicted = 'unsafe' AND truth = 'unsafe') AS unsafe_found,
  count(*) FILTER (WHERE predicted = 'unsafe') AS unsafe_predicted,
  count(*) FILTER (WHERE truth = 'unsafe') AS unsafe_true,
  count(*) FILTER (WHERE predicted = 'unknown' AND refused) AS refusals,
  count(*) FILTER (WHERE abs(proximity - 1.0) <= 0.25) AS near_boundary FROM sc""")
def evaluation_summary(spark, sf):
    return ev.summarize(scored(spark, sf))


@query("disagreements", _SCORED + """
SELECT case_id, idx, outcome, predicted, truth, high_ms, hold_ms FROM sc WHERE outcome <> 'match'""")
def disagreements(spark, sf):
    return ev.disagreements(scored(spark, sf)).select(
        "case_id", "idx", "outcome", "predicted", "truth", "high_ms", "hold_ms")


@query("long_exclusive_holds", _SCORED + """
SELECT case_id, idx, wall_ms, hold_ms FROM sc WHERE level = 8 AND wall_ms >= 1000""")
def long_exclusive_holds(spark, sf):
    return ev.long_exclusive_holds(scored(spark, sf))


# --- machine factors -------------------------------------------------------------
PROBES = ["create_index_single", "add_check", "reindex_index", "add_fk_plain",
          "alter_type_varchar_widen"]


def probe_readings(spark, sf) -> DataFrame:
    """Probe passes: one per user, each running its probes several times."""
    i, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf, "events").select(
        u.alias("pass_id"), (u * 60).alias("at_s"), pick(PROBES, i % 5).alias("case_id"),
        F.lit("t_1m").alias("table"),
        F.concat(F.lit("f"), (i % 4).cast("string")).alias("family"), i.alias("probe_no"),
        (F.floor(F.col("value") * 10) + 1).cast("bigint").alias("today_ms"))


def probe_reference(spark, sf) -> DataFrame:
    """Reference readings, the least of every probe; the fifth probe has none."""
    key = F.col("n_nationkey")
    return table(spark, sf, "nation").groupBy(
        pick(PROBES, key % 5).alias("case_id"), F.lit("t_1m").alias("table")).agg(
        F.min(F.when(key % 5 < 4, key * 100 + 50)).cast("bigint").alias("reference_ms"))


_RATIOS = """
WITH rd AS (SELECT user_id AS pass_id, user_id * 60 AS at_s, event_id % 5 AS probe, event_id AS no,
              'f' || CAST(event_id % 4 AS VARCHAR) AS family,
              CAST(floor(value * 10) AS BIGINT) + 1 AS today FROM events),
ratio AS (SELECT *, today / CAST(probe * 100 + 50 AS DOUBLE) AS f FROM rd WHERE probe < 4)
"""
_FACTORS = _RATIOS + """
, whole AS (SELECT pass_id, median(f) AS f FROM ratio GROUP BY 1),
common AS (SELECT pass_id, median(f) AS f FROM ratio WHERE probe IN (0, 1, 2) GROUP BY 1),
passes AS (SELECT p.pass_id, p.at_s, coalesce(c.f, w.f, 1.0) AS factor
           FROM (SELECT DISTINCT pass_id, at_s FROM rd) p
           LEFT JOIN whole w USING (pass_id) LEFT JOIN common c USING (pass_id))
"""


@query("pass_factors", _RATIOS + """
SELECT p.pass_id, p.at_s, round(coalesce(f, 1.0), 6) AS factor
FROM (SELECT DISTINCT pass_id, at_s FROM rd) p
LEFT JOIN (SELECT pass_id, median(f) AS f FROM ratio GROUP BY 1) USING (pass_id)""")
def pass_factors(spark, sf):
    return ev.pass_factors(probe_readings(spark, sf), probe_reference(spark, sf)).withColumn(
        "factor", F.round("factor", 6))


@query("family_factors", _RATIOS + """
SELECT pass_id, family, round(max_by(f, no), 6) AS factor FROM ratio GROUP BY 1, 2""")
def family_factors(spark, sf):
    return ev.family_factors(probe_readings(spark, sf), probe_reference(spark, sf)).withColumn(
        "factor", F.round("factor", 6))


@query("comparable_factors", _FACTORS + """
SELECT pass_id, at_s, round(factor, 6) AS factor FROM passes""")
def comparable_factors(spark, sf):
    return ev.comparable_factors(probe_readings(spark, sf), probe_reference(spark, sf)
                                 ).withColumn("factor", F.round("factor", 6))


_AT = """
, ev AS (SELECT o_orderkey AS id, o_orderkey % 12000 - 100 AS at_s FROM orders),
seg AS (SELECT at_s AS t0, factor AS f0, lead(at_s) OVER (ORDER BY at_s) AS t1,
               lead(factor) OVER (ORDER BY at_s) AS f1 FROM passes),
fx AS (
  SELECT id, at_s, CASE WHEN t0 IS NULL THEN (SELECT min_by(factor, at_s) FROM passes)
    WHEN t1 IS NULL THEN f0 ELSE f0 + (f1 - f0) * ((at_s - t0) / CAST(t1 - t0 AS DOUBLE)) END AS f
  FROM ev LEFT JOIN seg ON at_s > t0 AND (t1 IS NULL OR at_s <= t1))
"""


def timed_factors(spark, sf) -> DataFrame:
    passes = ev.comparable_factors(probe_readings(spark, sf), probe_reference(spark, sf)
                                   ).withColumn("run", F.lit(1))
    events = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 12000 - 100).alias("at_s"),
        F.lit(1).alias("run"))
    return ev.factor_at(events, passes, ["run"], chunk_s=600)


@query("factor_at_time", _FACTORS + _AT + """
SELECT id, CAST(round(f * 100000) AS BIGINT) AS factor_e5 FROM fx""")
def factor_at_time(spark, sf):
    return timed_factors(spark, sf).select(
        "id", F.round(F.col("factor") * 100000).cast("bigint").alias("factor_e5"))


@query("normalized_holds", """
SELECT event_id, CAST(round_even(work / CASE WHEN f <= 0 THEN 1.0 ELSE f END, 0) AS BIGINT) + wait
       AS hold_ms FROM (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS work,
                               event_id % 50 AS wait, (user_id % 5 - 1) / 2.0 AS f FROM events)""")
def normalized_holds(spark, sf):
    from changerisk.functions.tiers import normalized_hold

    factor = (F.col("user_id") % 5 - 1) / 2.0
    return table(spark, sf, "events").select("event_id", normalized_hold(
        F.floor(F.col("value") * 100).cast("bigint"), F.col("event_id") % 50, factor
    ).alias("hold_ms"))


@query("probe_correlation", _FACTORS + _AT + """
SELECT count(*) AS captures, round(corr(CAST(100 + id % 700 AS DOUBLE), f), 4) AS r FROM fx""")
def probe_correlation(spark, sf):
    from changerisk.operators.measure import probe_correlation as correlate

    captures = timed_factors(spark, sf).withColumn(
        "probe_ms", (F.col("id") % 700 + 100).cast("double"))
    return correlate(captures).withColumn("r", F.round("r", 4))
