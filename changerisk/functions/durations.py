"""The duration model as integer column expressions.

Milliseconds and bytes are bigint and factors are tenths, so results are the
same on every platform. An estimate is a struct with either the three bounds
or a ``refusal`` saying why there is none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.functions.binding import let
from changerisk.functions.facts import has, has_value
from changerisk.seeds import literal_map, tables

ESTIMATE_TYPE = ("struct<point_ms:bigint,low_ms:bigint,high_ms:bigint,confidence:string,"
                 "method:string,constant_key:string,refusal:string>")


def int_div(left: Column, right: Column | int) -> Column:
    """Integer division of non-negative values (SQL ``div``)."""
    right = F.lit(right) if isinstance(right, int) else right
    return F.call_function("div", left.cast("bigint"), right.cast("bigint"))


# --- rate table ------------------------------------------------------------
def base_widen(calibration: Column, runs: Column, spread: Column) -> Column:
    """Interval widening (tenths) a rate earns from how it was measured."""
    measured = F.least(F.greatest(spread, F.lit(tables.WIDEN_FLOOR)), F.lit(tables.WIDEN_CAP))
    return (F.when(calibration == "uncalibrated", F.lit(tables.WIDEN_GUESS))
            .when(calibration == "calibrated", F.lit(tables.WIDEN_CALIBRATED))
            .when(runs < 2, F.lit(tables.WIDEN_ONE_RUN))
            .otherwise(measured))


def boundary_spread(calibration: Column, profiles: Column, cross_spread: Column) -> Column:
    """Half-width (tenths) of the strip around a threshold that stays undecided."""
    observed = F.when(profiles >= tables.BOUNDARY_MIN_PROFILES, cross_spread).otherwise(F.lit(0))
    return (F.when(calibration == "uncalibrated", F.lit(tables.WIDEN_GUESS))
            .otherwise(F.greatest(observed, F.lit(tables.BOUNDARY_FLOOR))))


class RateTable:
    """Lookups over the rate constants; pass other rows to re-assess with them."""

    def __init__(self, rows: list[dict] | None = None) -> None:
        rows = tables.rate_rows() if rows is None else rows
        names = ("value", "calibration", "runs", "spread", "profiles", "cross_spread")
        self._rows = F.create_map(*[part for r in rows for part in (F.lit(r["key"]), F.struct(
            *[F.lit(r[n]).alias(n) for n in names]))])

    def _of(self, family: Column, body: Callable[[Column], Column]) -> Column:
        """What ``body`` makes of a family's row, NULL where there is none."""
        return let(F.try_element_at(self._rows, family),
                   lambda r: F.when(r.isNotNull(), body(r)).cast("bigint"))

    def value(self, family: Column) -> Column:
        return self._of(family, lambda r: r["value"])

    def widen(self, family: Column) -> Column:
        return self._of(family, lambda r: base_widen(r["calibration"], r["runs"], r["spread"]))

    def spread(self, family: Column) -> Column:
        return self._of(family, lambda r: boundary_spread(
            r["calibration"], r["profiles"], r["cross_spread"]))


# --- inputs ----------------------------------------------------------------
def usable_rows(facts: Column) -> Column:
    """``struct<rows, refusal>``: the row estimate or why it cannot be used."""
    exists, tuples = facts["exists"], facts["reltuples"]
    rows = F.greatest(tuples["value"], F.lit(0).cast("bigint"))
    never = (has(facts["last_analyze"]) & facts["last_analyze"]["value"].isNull()
             & has(facts["last_autoanalyze"]) & facts["last_autoanalyze"]["value"].isNull())
    refusal = (
        F.when(~has(exists), F.concat(F.lit("existence of the relation is unknown: "),
                                      F.coalesce(exists["reason"], F.lit("not gathered"))))
        .when(exists["value"] == F.lit(False),
              F.lit("the relation does not exist on the target database"))
        .when(~has_value(tuples), F.concat(F.lit("no usable row-count estimate: "),
                                           F.coalesce(tuples["reason"], F.lit("not gathered"))))
        .when((rows == 0) & never,
              F.lit("the row estimate is 0 and the table was never analyzed"))
    )
    return F.struct(F.when(refusal.isNull(), rows).alias("rows"), refusal.alias("refusal"))


def age_widen(facts: Column, server_now: Column) -> Column:
    """Widening (tenths) from the age of the newest statistics."""
    def known_time(fact: Column) -> Column:
        return F.when(has(fact), fact["value"])

    newest = F.greatest(known_time(facts["last_analyze"]), known_time(facts["last_autoanalyze"]))
    age = F.timestamp_diff("SECOND", newest, F.when(has(server_now), server_now["value"]))
    out = F.when(age.isNull(), F.lit(tables.AGE_WIDEN_OLD))
    for limit, tenths in tables.AGE_WIDEN:
        out = out.when(age <= limit, F.lit(tenths))
    return out.otherwise(F.lit(tables.AGE_WIDEN_OLD))


def mods_widen(facts: Column, rows: Column) -> Column:
    """``struct<tenths, refusal>`` from the rows modified since the last analyze."""
    fact = facts["n_mod"]
    mods = fact["value"]
    swamped = has_value(fact) & (mods > 0) & (rows < int_div(mods, 10))
    tenths = (
        F.when(~has_value(fact), F.lit(tables.MODS_WIDEN_UNKNOWN).cast("bigint"))
        .otherwise(F.least(F.lit(tables.MODS_WIDEN_CAP).cast("bigint"),
                           10 + int_div(10 * mods, F.greatest(rows, F.lit(1)))))
    )
    return F.struct(
        F.when(~swamped, tenths).alias("tenths"),
        F.when(swamped, F.lit("statistics unusable: rows modified since the last analyze "
                              "swamp the row estimate")).alias("refusal"),
    )


def staleness(age_tenths: Column, mods_tenths: Column) -> Column:
    return int_div(age_tenths * mods_tenths, 10)


def hardware_factor(probe: Column) -> Column:
    """Slow-down against the anchor machine in tenths, from the probe reading."""
    reading = F.greatest(F.lit(tables.PROBE_FLOOR_MS).cast("bigint"), probe["value"])
    raw = F.bround(10.0 * reading / tables.PROBE_ANCHOR_MS).cast("bigint")
    clamped = F.greatest(F.lit(tables.HARDWARE_MIN), F.least(F.lit(tables.HARDWARE_MAX), raw))
    return F.when(has_value(probe), clamped).otherwise(F.lit(10)).cast("bigint")


def confidence(widen_tenths: Column) -> Column:
    return (F.when(widen_tenths <= tables.CONFIDENCE_HIGH, "high")
            .when(widen_tenths <= tables.CONFIDENCE_MEDIUM, "medium").otherwise("low"))


def band(high_ms: Column) -> Column:
    """Order of magnitude of the worst plausible hold; NULL without an estimate."""
    out = F.when(high_ms.isNull(), F.lit(None).cast("string"))
    for name, limit in tables.BAND_LIMITS_MS:
        out = out.when(high_ms < limit, name)
    return out.otherwise("long")


def rows_family(kind: Column, index_method: Column, has_expression: Column) -> Column:
    """The rate family of a row-proportional kind, NULL when none is defined."""
    plain = F.try_element_at(literal_map(tables.rows_family()), kind)
    upgraded = ((plain == "index_build_btree") & kind.isin("create_index",
                                                            "create_index_concurrently")
                & ((F.coalesce(index_method, F.lit("btree")) != "btree")
                   | F.coalesce(has_expression, F.lit(False))))
    return F.when(upgraded, F.lit("index_build_expression")).otherwise(plain)


def bytes_family(kind: Column) -> Column:
    return F.try_element_at(literal_map(tables.BYTES_FAMILY), kind)


# --- estimates -------------------------------------------------------------
def _estimate(point: Column, low: Column, high: Column, conf: Column, method: Column,
              key: Column) -> Column:
    return F.struct(point.cast("bigint").alias("point_ms"), low.cast("bigint").alias("low_ms"),
                    high.cast("bigint").alias("high_ms"), conf.alias("confidence"),
                    method.alias("method"), key.alias("constant_key"),
                    F.lit(None).cast("string").alias("refusal"))


def refuse(reason: Column, method: str = "unverified") -> Column:
    return F.expr(
        "named_struct('point_ms', cast(NULL AS bigint), 'low_ms', cast(NULL AS bigint), "
        "'high_ms', cast(NULL AS bigint), 'confidence', cast(NULL AS string), "
        f"'method', '{method}', 'constant_key', cast(NULL AS string), 'refusal', "
        "cast(NULL AS string))").withField("refusal", reason)


def proportional(work_ms: Column, widen_tenths: Column, factor_tenths: Column,
                 key: Column) -> Column:
    """Scale the proportional part, widen it, and add the fixed overhead."""
    scaled = int_div(work_ms * factor_tenths, 10)
    high = F.greatest(int_div(scaled * widen_tenths, 10), scaled)
    return _estimate(
        scaled + tables.OVERHEAD_POINT_MS,
        int_div(scaled * 10, widen_tenths) + tables.OVERHEAD_LOW_MS,
        high + tables.OVERHEAD_HIGH_MS,
        confidence(widen_tenths), F.lit("simulated"), key,
    )


def with_sizing(df: DataFrame, facts: str = "facts", server_now: str = "server_now",
                probe: str = "probe") -> DataFrame:
    """Add ``sizing``: usable rows, staleness and hardware factor, or a refusal."""
    staged = df.withColumn("__rows", usable_rows(F.col(facts)))
    staged = staged.withColumn("__mods", mods_widen(F.col(facts), F.col("__rows.rows")))
    stale = staleness(age_widen(F.col(facts), F.col(server_now)), F.col("__mods.tenths"))
    return staged.withColumn("sizing", F.struct(
        F.col("__rows.rows").alias("rows"), stale.alias("stale"),
        hardware_factor(F.col(probe)).alias("factor"),
        F.coalesce(F.col("__rows.refusal"), F.col("__mods.refusal")).alias("refusal"),
    )).drop("__rows", "__mods")


def estimate_rows(sizing: Column, family: Column, rates: RateTable) -> Column:
    """Rows over throughput, or the first reason there is no estimate."""
    work = int_div(sizing["rows"] * 1000, rates.value(family))
    widen = int_div(rates.widen(family) * sizing["stale"], 10)
    return (F.when(sizing["refusal"].isNotNull(), refuse(sizing["refusal"]))
            .otherwise(proportional(work, widen, sizing["factor"], family)))


def estimate_rebuilds(sizing: Column, families: Column, rates: RateTable) -> Column:
    """One heap scan and build per rebuilt index; the slowest part names the rate.

    ``families`` is the array of rate families of the indexes in order.
    """
    parts = F.transform(families, lambda f: int_div(sizing["rows"] * 1000, rates.value(f)))
    work = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, part: acc + part)
    slowest = F.try_element_at(families,
                               F.array_position(parts, F.array_max(parts)).cast("int"))
    widen = int_div(F.array_max(F.transform(families, rates.widen)) * sizing["stale"], 10)
    return (F.when(sizing["refusal"].isNotNull(), refuse(sizing["refusal"]))
            .otherwise(proportional(work, widen, sizing["factor"], slowest)))


def estimate_bytes(size_bytes: Column, factor_tenths: Column, family: Column,
                   rates: RateTable) -> Column:
    """Bytes over throughput; sizes are live facts, so nothing is stale."""
    work = int_div(size_bytes * 1000, rates.value(family))
    return proportional(work, rates.widen(family), factor_tenths, family)


def fixed_cost(method: Column | str = "proven") -> Column:
    """A catalog-only operation: 10 ms, between 1 and 100."""
    point = next(r["value"] for r in tables.rate_rows() if r["key"] == "constant_op")
    method = F.lit(method) if isinstance(method, str) else method
    return _estimate(F.lit(point), F.lit(point * 10 // tables.WIDEN_FIXED_COST),
                     F.lit(point * tables.WIDEN_FIXED_COST // 10), F.lit("medium"), method,
                     F.lit("constant_op"))
