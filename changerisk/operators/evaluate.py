"""Predictions scored against measured truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changerisk.functions import tiers
from changerisk.functions.durations import int_div
from changerisk.operators.distribution import medians, order_statistics, prefix_scan
from changerisk.seeds import literal_map, tables
from changerisk.session import broadcast_if_small


# --- labels ------------------------------------------------------------------
def label_results(results: DataFrame) -> DataFrame:
    """Add truth labels under each basis, the outcome and the used label.

    ``factor`` is the machine factor at the time of the run, ``family_factor``
    the factor of the deciding rate's family (NULL when none was probed) and
    ``probe_scaled`` says that the estimate was already scaled to the machine,
    so the raw hold is the truth.
    """
    def label(factor: Column) -> Column:
        hold = tiers.normalized_hold(F.col("work_ms"), F.col("wait_ms"), factor)
        return tiers.truth(F.col("error"), F.col("level"), hold, F.col("is_dml"),
                           F.col("rows_touched"), F.col("irreversible"))

    normalized = tiers.normalized_hold(F.col("work_ms"), F.col("wait_ms"), F.col("factor"))
    raw = F.col("work_ms") + F.col("wait_ms")
    labelled = results.select(
        "*", label(F.col("factor")).alias("truth_normalized"),
        label(F.lit(1.0)).alias("truth_raw"),
        F.when(F.col("family_factor").isNotNull(), label(F.col("family_factor"))
               ).alias("truth_family"),
        raw.alias("hold_raw"), normalized.alias("hold_normalized"))
    used = F.when(F.col("probe_scaled"), F.col("truth_raw")).otherwise(
        F.col("truth_normalized"))
    return labelled.select(
        "*", used["tier"].alias("truth"), used["block"].alias("block"),
        used["proximity"].alias("proximity"),
        F.when(F.col("probe_scaled"), F.col("hold_raw")).otherwise(F.col("hold_normalized"))
        .alias("hold_ms"),
        tiers.outcome(F.col("predicted"), used["tier"]).alias("outcome"))


def expectation_mismatches(scored: DataFrame) -> DataFrame:
    """Add ``mismatches``: the author's expectations the measurement contradicts.

    A lock that was too short to be sampled contradicts nothing.
    """
    level = F.col("level")
    unsampled = level.isNull() & (F.col("error") | (F.col("wall_ms") < 30))
    checks = {
        "tier": F.col("expected_tier") != F.col("truth"),
        "lock": ~F.col("expected_level").eqNullSafe(level) & ~unsampled,
        "rewrite": F.col("rewrote").isNotNull() & (F.col("expected_rewrite") != F.col("rewrote")),
        "error": F.col("expected_error") != F.col("error"),
    }
    return scored.withColumn("mismatches", F.array_compact(F.array(
        *[F.when(F.coalesce(test, F.lit(False)), name) for name, test in checks.items()])))


def strongest_modes(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Strongest lock level sampled per key, from server mode spellings."""
    return samples.groupBy(*keys).agg(F.max(tiers.mode_level(F.col("mode"))).alias("level"))


def deciding_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The first worst part of each statement with its rate and upper bound."""
    rank = tiers.tier_rank(F.col("tier"))
    first = F.min_by(F.struct("kind", "tier", "constant_key", "high_ms"),
                     F.struct(-rank, F.col("part_pos")))
    return parts.groupBy(*keys).agg(first.alias("d")).select(
        *keys, F.col("d.kind").alias("deciding_kind"), F.col("d.tier").alias("predicted"),
        F.col("d.constant_key"), F.col("d.high_ms"))


# --- scores ------------------------------------------------------------------
def tier_scores(scored: DataFrame, truth: str = "truth") -> DataFrame:
    """Precision and recall per tier; NULL on an empty denominator.

    One pass with a fixed set of counters, then one row per tier.
    """
    p, t = F.col("predicted"), F.col(truth)
    counters = []
    for tier in tables.SCORED_TIERS:
        counters.append(F.struct(
            F.lit(tier).alias("tier"), F.count_if(p == tier).alias("predicted"),
            F.count_if(t == tier).alias("truth"),
            F.count_if((p == tier) & (t == tier)).alias("tp"),
            F.count_if((p == tier) & (t != tier)).alias("fp"),
            F.count_if((p != tier) & (t == tier)).alias("fn"),
            F.count_if((p == "unknown") & (t == tier)).alias("fn_as_unknown")))
    return (scored.agg(F.array(*counters).alias("scores"))
            .select(F.inline("scores"))
            .withColumn("precision", F.try_divide(F.col("tp"), F.col("predicted")))
            .withColumn("recall", F.try_divide(F.col("tp"), F.col("truth"))))


def wrong_cases(scored: DataFrame) -> DataFrame:
    """The cases behind false positives and false negatives, one row each."""
    return scored.filter(F.col("predicted") != F.col("truth")).select(
        "case_id", "idx", "predicted", "truth", "outcome")


def confusion(scored: DataFrame) -> DataFrame:
    """Five predicted tiers by four true tiers, zero-filled."""
    spark = scored.sparkSession
    cells = scored.groupBy("predicted").agg(*[
        F.count_if(F.col("truth") == t).alias(t) for t in tables.SCORED_TIERS])
    order = spark.range(1).select(
        F.posexplode(F.array(*[F.lit(t) for t in tables.TIERS])).alias("place", "predicted"))
    return order.join(cells, "predicted", "left").fillna(0).drop("place")


def outcome_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("outcome").agg(F.count("*").alias("n"))


def error_breakdown(scored: DataFrame) -> DataFrame:
    """Outcomes by kind, deciding rule, rate, family and adversarial class.

    The five breakdowns are grouping sets over one pass.
    """
    prepared = scored.select(
        "outcome", F.col("kind").alias("statement_kind"), F.col("deciding_kind"),
        F.coalesce("constant_key", F.lit("(no duration constant)")).alias("constant"),
        F.col("family"), F.coalesce("adversarial", F.lit("(plain)")).alias("adversarial"))
    names = ["statement_kind", "deciding_kind", "constant", "family", "adversarial"]
    sets = prepared.groupingSets([[F.col(n)] for n in names], *names).agg(
        F.coalesce(*[F.when(F.grouping(n) == 0, F.lit(n)) for n in names]).alias("breakdown"),
        F.count("*").alias("total"),
        *[F.count_if(F.col("outcome") == o).alias(o)
          for o in ("match", "strict", "lenient", "unknown")])
    key = F.coalesce(*[F.when(F.col("breakdown") == n, F.col(n)) for n in names])
    return (sets.select("breakdown", key.alias("key"), "total", "match", "strict", "lenient",
                        "unknown").filter(F.col("key").isNotNull()))


def file_scores(scored: DataFrame) -> DataFrame:
    """Predicted and true verdict of every file and the direction of the error."""
    def verdict_of(column: str) -> Column:
        rank = file_rank(F.col(column))
        return tiers.verdict_of_rank(F.max(rank))

    return scored.groupBy("case_id").agg(
        verdict_of("predicted").alias("predicted"), verdict_of("truth").alias("truth")
    ).withColumn("direction", F.when(F.col("predicted") == F.col("truth"), "match").when(
        tiers.verdict_rank(F.col("predicted")) < tiers.verdict_rank(F.col("truth")), "lenient")
        .otherwise("strict"))


def file_rank(tier: Column) -> Column:
    """Rank of the file verdict a tier leads to."""
    verdict = F.try_element_at(literal_map(tables.FILE_VERDICT), tier)
    return tiers.verdict_rank(verdict)


def file_level_scores(files: DataFrame) -> DataFrame:
    """Precision and recall per file verdict."""
    p, t = F.col("predicted"), F.col("truth")
    counters = [F.struct(F.lit(v).alias("verdict"), F.count_if(p == v).alias("predicted"),
                         F.count_if(t == v).alias("truth"),
                         F.count_if((p == v) & (t == v)).alias("tp"))
                for v in tables.FILE_VERDICTS]
    return (files.agg(F.array(*counters).alias("scores")).select(F.inline("scores"))
            .withColumn("precision", F.try_divide(F.col("tp"), F.col("predicted")))
            .withColumn("recall", F.try_divide(F.col("tp"), F.col("truth"))))


def boundary_cases(scored: DataFrame, window: float = 0.25) -> DataFrame:
    """Holds within ``window`` of a threshold, nearest first."""
    distance = F.abs(F.col("proximity") - 1.0)
    return scored.filter(distance <= window).orderBy(distance, "case_id", "idx")


def refusal_ledger(scored: DataFrame) -> DataFrame:
    """Boundary refusals with what the replaced tier would have scored."""
    return scored.filter((F.col("predicted") == "unknown") & (F.col("refusal") == "boundary")
                         ).select("case_id", "idx", "refused_from", "truth", tiers.outcome(
                             F.col("refused_from"), F.col("truth")).alias("would_have_been"))


def probe_statistics(readings: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, least, upper median and greatest reading."""
    n = F.col("n")
    return order_statistics(readings, keys, value, {
        "least": F.lit(0), "upper_median": int_div(n, 2), "greatest": n - 1})


def normalization_sensitivity(scored: DataFrame) -> DataFrame:
    """Outcome counts under each label basis and how many labels each flips."""
    variants = scored.select("predicted", "truth", F.explode(F.create_map(
        F.lit("raw"), F.col("truth_raw.tier"), F.lit("normalized"),
        F.col("truth_normalized.tier"), F.lit("per_family"), F.col("truth_family.tier"),
        F.lit("used"), F.col("truth"))).alias("variant", "label"))
    return (variants.filter(F.col("label").isNotNull()).groupBy("variant").agg(
        F.count("*").alias("labelled"),
        F.count_if(F.col("label") != F.col("truth")).alias("flipped"),
        *[F.count_if(tiers.outcome(F.col("predicted"), F.col("label")) == o).alias(o)
          for o in ("match", "strict", "lenient", "unknown")]))


def summarize(scored: DataFrame) -> DataFrame:
    """One row with the headline numbers of a run."""
    p, t, o = F.col("predicted"), F.col("truth"), F.col("outcome")
    return scored.agg(
        F.count("*").alias("statements"), F.count_if("error").alias("errors"),
        *[F.count_if(o == x).alias(x) for x in ("match", "strict", "lenient", "unknown")],
        F.count_if((p == "unsafe") & (t == "unsafe")).alias("unsafe_found"),
        F.count_if(p == "unsafe").alias("unsafe_predicted"),
        F.count_if(t == "unsafe").alias("unsafe_true"),
        F.count_if((p == "unknown") & (F.col("refusal") == "boundary")).alias("refusals"),
        F.count_if(F.abs(F.col("proximity") - 1.0) <= 0.25).alias("near_boundary"))


def disagreements(scored: DataFrame) -> DataFrame:
    """Statements whose prediction differs from the truth, with what was measured."""
    return scored.filter(F.col("outcome") != "match").select(
        "case_id", "idx", "outcome", "predicted", "truth", "high_ms", "hold_ms", "wait_ms",
        "level", "constant_key", "error")


def long_exclusive_holds(scored: DataFrame, at_least_ms: int = 1000) -> DataFrame:
    """ACCESS EXCLUSIVE holds long enough that readers should have stalled."""
    return scored.filter((F.col("level") == 8) & (F.col("wall_ms") >= at_least_ms)).select(
        "case_id", "idx", "wall_ms", "hold_ms")


# --- machine factors -----------------------------------------------------------
def _pass_medians(readings: DataFrame, reference: DataFrame) -> DataFrame:
    """Median of today over reference per pass; passes without any ratio are left out."""
    ratios = (readings.join(broadcast_if_small(reference), ["case_id", "table"])
              .filter(F.col("reference_ms") > 0)
              .withColumn("ratio", F.col("today_ms") / F.col("reference_ms")))
    return medians(ratios, ["pass_id"], "ratio").select("pass_id", F.col("median").alias("f"))


def _passes(readings: DataFrame) -> DataFrame:
    return readings.groupBy("pass_id").agg(F.min("at_s").alias("at_s"))


def pass_factors(readings: DataFrame, reference: DataFrame) -> DataFrame:
    """Machine factor of each probe pass: the median of today over reference, 1 without any."""
    return _passes(readings).join(_pass_medians(readings, reference), "pass_id", "left").select(
        "pass_id", "at_s", F.coalesce("f", F.lit(1.0)).alias("factor"))


def family_factors(readings: DataFrame, reference: DataFrame) -> DataFrame:
    """Factor of each rate family in a pass; its last probe counts."""
    ratios = (readings.join(broadcast_if_small(reference), ["case_id", "table"])
              .filter(F.col("reference_ms") > 0))
    return ratios.groupBy("pass_id", "family").agg(
        F.max_by(F.col("today_ms") / F.col("reference_ms"), F.col("probe_no")).alias("factor"))


def comparable_factors(readings: DataFrame, reference: DataFrame) -> DataFrame:
    """Pass factor over the probes every pass runs, else over all of them, else 1.

    Shared probes without a reference say nothing, so the pass then falls back
    to all its probes.
    """
    shared = F.concat_ws("/", "case_id", "table").isin(
        *[f"{c}/{t}" for c, t in tables.COMPARABLE_PROBES])
    common = _pass_medians(readings.filter(shared), reference).withColumnRenamed("f", "common")
    return (_passes(readings).join(_pass_medians(readings, reference), "pass_id", "left")
            .join(common, "pass_id", "left")
            .select("pass_id", "at_s", F.coalesce("common", "f", F.lit(1.0)).alias("factor")))


def factor_at(events: DataFrame, passes: DataFrame, keys: list[str],
              chunk_s: int = 3600) -> DataFrame:
    """Machine factor at each event's ``at_s``, linear between probe passes.

    An as-of join: passes carry their following pass, and every event takes
    the last pass before it from one ordered scan cut into ``chunk_s`` pieces.
    Before the first pass the first factor applies, after the last the last.
    """
    order = W.partitionBy(*keys).orderBy("at_s")
    segments = passes.select(
        *keys, "at_s", F.struct(
            F.col("at_s").alias("t0"), F.col("factor").alias("f0"),
            F.lead("at_s").over(order).alias("t1"), F.lead("factor").over(order).alias("f1"),
        ).alias("segment"), F.lit(1).alias("is_pass"))
    rows = events.withColumn("is_pass", F.lit(0)).unionByName(segments, allowMissingColumns=True)
    scanned = prefix_scan(rows, keys, ["at_s", "is_pass"], F.floor(F.col("at_s") / chunk_s),
                          {"before": ("last", F.col("segment"))})
    first = broadcast_if_small(passes.groupBy(*keys).agg(
        F.min_by("factor", "at_s").alias("first_factor")))
    joined = scanned.filter("is_pass = 0").join(first, keys, "left")
    b = F.col("before")
    share = (F.col("at_s") - b["t0"]) / (b["t1"] - b["t0"])
    factor = (F.when(b.isNull(), F.coalesce("first_factor", F.lit(1.0)))
              .when(b["t1"].isNull(), b["f0"])
              .otherwise(b["f0"] + (b["f1"] - b["f0"]) * share))
    return joined.select(*events.columns, factor.alias("factor"))
