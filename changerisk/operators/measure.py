"""Throughput constants and interval coverage from measured readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changerisk.functions import tiers
from changerisk.functions.durations import int_div
from changerisk.operators.distribution import medians, order_statistics
from changerisk.seeds import literal_map, tables
from changerisk.session import broadcast_if_small


def reading_rate(family: Column, rows: Column, ms: Column, index_bytes: Column) -> Column:
    """Rows or bytes per second; the milliseconds themselves for fixed-cost work."""
    positive = F.when(ms > 0, ms)
    return (F.when(family == "constant_op", ms)
            .when(family == "index_bytes", int_div(index_bytes * 1000, positive))
            .otherwise(int_div(rows * 1000, positive)))


def at_scale(family: Column, rows: Column) -> Column:
    floor = F.coalesce(F.try_element_at(literal_map(tables.AT_SCALE_ROWS), family),
                       F.lit(tables.AT_SCALE_DEFAULT))
    return rows >= floor


def scale_readings(readings: DataFrame) -> DataFrame:
    """Error-free readings at scale with their rate."""
    return (readings.filter(~F.col("error") & at_scale(F.col("family"), F.col("rows")))
            .withColumn("rate", reading_rate(F.col("family"), F.col("rows"), F.col("ms"),
                                             F.col("index_bytes")))
            .filter(F.col("rate").isNotNull()))


def spread_tenths(least: Column, greatest: Column, n: Column) -> Column:
    """Greatest over least in tenths, rounded up; 0 below two readings."""
    return F.when(n < 2, F.lit(0)).otherwise(
        F.coalesce(F.ceil(10 * greatest.cast("double") / least), F.lit(0))).cast("bigint")


def probe_medians(probes: DataFrame) -> DataFrame:
    """Median probe reading of each profile."""
    return medians(probes, ["profile"], "compute_ms").select(
        "profile", F.col("median").alias("compute_ms"))


def profile_constants(readings: DataFrame, probes: DataFrame, anchor: str) -> DataFrame:
    """Value of each rate per profile, its spread, and the value at the anchor's speed.

    The slowest reading at scale counts; the median for fixed-cost work.
    """
    rated = scale_readings(readings)
    stats = rated.groupBy("family", "profile").agg(
        F.count("*").alias("readings"), F.min("rate").alias("least"),
        F.max("rate").alias("greatest"),
        F.min(F.when(F.col("rate") > 0, F.col("rate"))).alias("least_positive"),
        F.count_if(F.col("rate") > 0).alias("positive"))
    fixed = medians(rated.filter(F.col("family") == "constant_op"), ["family", "profile"],
                    "rate").select("family", "profile", F.floor("median").alias("middle"))
    speeds = probe_medians(probes)
    anchor_ms = speeds.filter(F.col("profile") == anchor).select(
        F.col("compute_ms").alias("anchor_ms"), F.lit(1).alias("one"))
    factors = speeds.withColumn("one", F.lit(1)).join(
        broadcast_if_small(anchor_ms), "one", "left").select(
        "profile", F.try_divide(F.col("compute_ms"), F.col("anchor_ms")).alias("factor"))
    value = F.when(F.col("family") == "constant_op", F.col("middle")).otherwise(F.col("least"))
    joined = (stats.join(fixed, ["family", "profile"], "left")
              .join(broadcast_if_small(factors), "profile", "left"))
    scaled = F.when(F.col("family") == "constant_op", value / F.col("factor")).otherwise(
        value * F.col("factor"))
    return joined.select(
        "family", "profile", "readings", value.alias("value"),
        spread_tenths(F.col("least_positive"), F.col("greatest"), F.col("positive")
                      ).alias("within_spread"),
        "factor", scaled.alias("scaled"))


def derive_constants(per_profile: DataFrame, anchor: str) -> DataFrame:
    """One row per rate: the anchor's value and the spreads across profiles."""
    def spread(column: str) -> Column:
        positive = F.when(F.col(column) > 0, F.col(column))
        return spread_tenths(F.min(positive), F.max(positive), F.count(positive))

    return per_profile.groupBy("family").agg(
        F.count("*").alias("profiles"),
        F.max(F.when(F.col("profile") == anchor, F.col("value"))).alias("anchor_value"),
        spread("value").alias("cross_spread_raw"), spread("scaled").alias("cross_spread_scaled"),
        F.max("within_spread").alias("within_spread_max"))


# --- interval coverage ---------------------------------------------------------
def best_duration(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The estimate with the highest upper bound per key."""
    estimates = parts.filter(F.col("high_ms").isNotNull())
    return estimates.groupBy(*keys).agg(F.max_by(
        F.struct("low_ms", "point_ms", "high_ms", "constant_key"),
        F.struct("high_ms", -F.col("part_pos"))).alias("d")).select(*keys, "d.*")


def coverage_status(low: Column, high: Column, measured: Column, error: Column) -> Column:
    return (F.when(error, "ERR").when(high.isNull() | measured.isNull(), "-")
            .when(measured < low, "LOW").when(measured > high, "HIGH").otherwise("IN"))


def interval_coverage(cases: DataFrame) -> DataFrame:
    """Readings inside, below and above their interval, and how wide the intervals are.

    ``cases`` holds ``low_ms, high_ms, measured_ms, error``.
    """
    status = coverage_status(F.col("low_ms"), F.col("high_ms"), F.col("measured_ms"),
                             F.col("error"))
    counted = (cases.withColumn("status", status)
               .filter(F.col("status").isin("IN", "LOW", "HIGH"))
               .withColumn("width", F.col("high_ms") / F.greatest("low_ms", F.lit(1)))
               .withColumn("over", F.col("high_ms") / F.greatest("measured_ms", F.lit(1)))
               .withColumn("one", F.lit(1)))
    counts = counted.groupBy("one").agg(*[
        F.count_if(F.col("status") == s).alias(name)
        for s, name in (("IN", "inside"), ("LOW", "below"), ("HIGH", "above"))])
    n = F.col("n")
    width = medians(counted, ["one"], "width").select("one", F.col("median").alias(
        "median_width"))
    over = order_statistics(counted, ["one"], "over", {
        "a": F.floor((n - 1) / 2), "b": F.floor(n / 2), "p90": F.floor(n * 0.9)}).select(
        "one", ((F.col("a") + F.col("b")) / 2).alias("median_over"), F.col("p90").alias("p90_over"))
    return (counts.join(F.broadcast(width), "one").join(F.broadcast(over), "one").drop("one"))


def size_distribution(cases: DataFrame, sizes: list[str]) -> DataFrame:
    """Tier counts per table size, zero-filled."""
    return cases.groupBy("tier").agg(*[
        F.count_if(F.col("table") == s).alias(s) for s in sizes])


def case_grid(cases: DataFrame, sizes: list[str]) -> DataFrame:
    """Tier of each case at each size."""
    return cases.groupBy("case_id").pivot("table", sizes).agg(F.max("tier"))


def guess_vs_measured(cases: DataFrame, large: list[str]) -> DataFrame:
    """Median measured rate per family, at scale where there are such readings."""
    rated = cases.filter(F.col("rate").isNotNull())
    whole = medians(rated, ["family"], "rate").select(
        "family", F.col("n").alias("samples"), F.col("median").alias("median_all"))
    big = medians(rated.filter(F.col("table").isin(*large)), ["family"], "rate").select(
        "family", F.col("n").alias("large_samples"), F.col("median").alias("median_large"))
    return whole.join(big, "family", "left").select(
        "family", "samples", F.coalesce("large_samples", F.lit(0)).alias("large_samples"),
        F.coalesce("median_large", "median_all").alias("median_rate"))


def lock_mismatches(cases: DataFrame) -> DataFrame:
    """Cases whose sampled lock differs from the predicted one; unsampled ones pass."""
    return cases.filter(F.col("measured_level").isNotNull()
                        & (F.col("measured_level") != F.col("predicted_level")))


def boundary_crossings(cases: DataFrame) -> DataFrame:
    """Readings outside their interval, re-banded: does the tier change?

    ``dangerous`` means that the prediction was the more lenient one.
    """
    status = coverage_status(F.col("low_ms"), F.col("high_ms"), F.col("measured_ms"),
                             F.lit(False))
    reads = F.col("predicted_level") == 8
    block = F.when(reads, "reads").otherwise("writes")
    banded = tiers.threshold_tier(F.col("measured_ms"), block)
    measured = F.when(reads & (banded == "safe"), "needs_timing").otherwise(banded)
    rank = {"safe": 0, "safe_irreversible": 0, "needs_timing": 1, "unsafe": 2}
    delta = (F.try_element_at(literal_map(rank), measured)
             - F.try_element_at(literal_map(rank), F.col("tier")))
    return (cases.withColumn("status", status).filter(F.col("status").isin("LOW", "HIGH"))
            .withColumn("measured_tier", measured).withColumn("delta", delta)
            .withColumn("crosses", F.coalesce(F.col("delta") != 0, F.lit(False)))
            .withColumn("dangerous", F.coalesce(F.col("delta") > 0, F.lit(False))))


def non_monotone_cases(cases: DataFrame) -> DataFrame:
    """Cases whose tier softens as their table grows (``size`` is the row count)."""
    rank = tiers.tier_rank(F.col("tier"))
    # a case runs at a handful of sizes, so its window is a few rows
    sizes = cases.groupBy("case_id", "size").agg(F.max(rank).alias("rank"))
    order = W.partitionBy("case_id").orderBy("size")
    steps = sizes.withColumn("softer", F.col("rank") < F.lag("rank").over(order))
    return steps.groupBy("case_id").agg(F.bool_or(F.coalesce("softer", F.lit(False))
                                                  ).alias("softer")).filter("softer").select(
        "case_id")


def probe_correlation(captures: DataFrame) -> DataFrame:
    """Correlation of the probe reading and the machine factor over captures."""
    return captures.agg(F.corr("probe_ms", "factor").alias("r"), F.count("*").alias("captures"))
