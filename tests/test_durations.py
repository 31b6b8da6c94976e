"""Boundaries of the duration model."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from changerisk.functions import durations as du
from changerisk.functions import tiers
from changerisk.functions.facts import known, unavailable


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(("reading", "factor"), [
    (215, 10), (430, 20), (1, 3), (2, 3), (10_000, 80), (225, 10), (226, 11)])
def test_hardware_factor(spark, reading, factor):
    probe = known(F.lit(reading).cast("bigint"))
    assert one(spark, f=du.hardware_factor(probe))["f"] == factor


def test_no_probe_is_unscaled(spark):
    assert one(spark, f=du.hardware_factor(unavailable(F.lit("timeout"), "bigint")))["f"] == 10


@pytest.mark.parametrize(("ms", "band"), [
    (999, "sub_second"), (1000, "seconds"), (59_999, "seconds"), (60_000, "minutes"),
    (3_599_999, "minutes"), (3_600_000, "long")])
def test_bands(spark, ms, band):
    assert one(spark, b=du.band(F.lit(ms)))["b"] == band


@pytest.mark.parametrize(("block", "ms", "tier"), [
    ("reads", 1999, "safe"), ("reads", 2000, "needs_timing"), ("reads", 19_999, "needs_timing"),
    ("reads", 20_000, "unsafe"), ("writes", 4999, "safe"), ("writes", 5000, "needs_timing"),
    ("writes", 59_999, "needs_timing"), ("writes", 60_000, "unsafe")])
def test_threshold_lines(spark, block, ms, tier):
    assert one(spark, t=tiers.threshold_tier(F.lit(ms), F.lit(block)))["t"] == tier


@pytest.mark.parametrize(("age_s", "tenths"), [
    (0, 10), (86_400, 10), (86_401, 15), (8 * 86_400 - 1, 15), (8 * 86_400, 20),
    (31 * 86_400 - 1, 20), (31 * 86_400, 30)])
def test_statistics_age(spark, age_s, tenths):
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    facts = F.struct(
        known(now - F.make_dt_interval(secs=F.lit(age_s))).alias("last_analyze"),
        known(F.lit(None).cast("timestamp")).alias("last_autoanalyze"))
    assert one(spark, t=du.age_widen(facts, known(now)))["t"] == tenths


def test_unknown_age_widens_most(spark):
    none = known(F.lit(None).cast("timestamp"))
    facts = F.struct(none.alias("last_analyze"), none.alias("last_autoanalyze"))
    assert one(spark, t=du.age_widen(facts, known(F.current_timestamp())))["t"] == 30


def test_churn_that_swamps_the_estimate_refuses(spark):
    def mods(n, rows):
        facts = F.struct(known(F.lit(n).cast("bigint")).alias("n_mod"))
        return one(spark, m=du.mods_widen(facts, F.lit(rows).cast("bigint")))["m"]

    assert mods(1000, 99)["refusal"] and mods(1000, 100)["refusal"] is None
    assert mods(1000, 100)["tenths"] == 50 and mods(50, 100)["tenths"] == 15


def test_slowest_rebuild_names_the_rate(spark):
    sizing = F.struct(F.lit(1_000_000).cast("bigint").alias("rows"),
                      F.lit(10).cast("bigint").alias("stale"),
                      F.lit(10).cast("bigint").alias("factor"),
                      F.lit(None).cast("string").alias("refusal"))
    families = F.array(F.lit("index_build_btree"), F.lit("index_build_expression"))
    e = one(spark, e=du.estimate_rebuilds(sizing, families, du.RateTable()))["e"]
    assert e["constant_key"] == "index_build_expression"
    assert e["point_ms"] == 1_000_000_000 // 740_000 + 1_000_000_000 // 170_000 + 10


def test_guess_is_wider_than_a_measurement(spark):
    row = one(spark, guess=du.base_widen(F.lit("uncalibrated"), F.lit(0), F.lit(0)),
              once=du.base_widen(F.lit("measured"), F.lit(1), F.lit(11)),
              twice=du.base_widen(F.lit("measured"), F.lit(2), F.lit(12)),
              scattered=du.base_widen(F.lit("measured"), F.lit(2), F.lit(39)))
    assert (row["guess"], row["once"], row["twice"], row["scattered"]) == (40, 30, 15, 20)
