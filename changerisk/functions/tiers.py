"""Ranks, thresholds and ladders as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changerisk.functions.durations import int_div
from changerisk.seeds import literal_map, tables


def tier_rank(tier: Column) -> Column:
    return F.try_element_at(literal_map(tables.TIER_RANK), tier)


def tier_of_rank(rank: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(t) for t in tables.TIERS]), (rank + 1).cast("int"))


def is_safe(tier: Column) -> Column:
    return tier.isin("safe", "safe_irreversible")


def evidence_rank(method: Column) -> Column:
    return F.try_element_at(literal_map(tables.EVIDENCE_RANK), method)


def weakest(*methods: Column) -> Column:
    """A conclusion is only as strong as its weakest evidence."""
    rank = F.least(*[evidence_rank(m) for m in methods]) if len(methods) > 1 \
        else evidence_rank(methods[0])
    return F.try_element_at(F.array(*[F.lit(m) for m in tables.EVIDENCE_RANK]),
                            (rank + 1).cast("int"))


def short_ms(block: Column) -> Column:
    return F.when(block == "reads", tables.READS_SHORT_MS).otherwise(tables.WRITES_SHORT_MS)


def long_ms(block: Column) -> Column:
    return F.when(block == "reads", tables.READS_LONG_MS).otherwise(tables.WRITES_LONG_MS)


def threshold_tier(hold_ms: Column, block: Column) -> Column:
    """Tier of a hold against the lines of what it blocks."""
    return (F.when(hold_ms < short_ms(block), "safe")
            .when(hold_ms < long_ms(block), "needs_timing").otherwise("unsafe"))


def boundary_refusal(point_ms: Column, spread_tenths: Column, block: Column,
                     short_matters: Column) -> Column:
    """The threshold (ms) inside the strip a rate's spread draws, else NULL.

    The strip surrounds the proportional part only; the long line is tested
    before the short one.
    """
    part = F.greatest(point_ms - tables.OVERHEAD_POINT_MS, F.lit(0).cast("bigint"))
    low, high = int_div(part * 10, spread_tenths), int_div(part * spread_tenths, 10)

    def inside(line: Column) -> Column:
        return (low < line) & (line <= high)

    return F.when((part > 0) & spread_tenths.isNotNull(),
                  F.when(inside(long_ms(block)), long_ms(block))
                  .when(short_matters & inside(short_ms(block)), short_ms(block)))


# --- files and runs ----------------------------------------------------------
def file_verdict(worst_rank: Column) -> Column:
    """Verdict of a file from its worst tier rank; a file without statements proceeds."""
    tier = tier_of_rank(worst_rank)
    return F.coalesce(F.try_element_at(literal_map(tables.FILE_VERDICT), tier),
                      F.lit("proceed"))


def verdict_rank(verdict: Column) -> Column:
    return F.try_element_at(literal_map({v: i for i, v in enumerate(tables.FILE_VERDICTS)}),
                            verdict)


def verdict_of_rank(rank: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(v) for v in tables.FILE_VERDICTS]),
                            (rank + 1).cast("int"))


def exit_code(verdict: Column, fail_on: Column | str) -> Column:
    """0 passes, 1 asks for approval, 2 blocks; ``fail_on`` sets what fails a run."""
    fail_on = F.lit(fail_on) if isinstance(fail_on, str) else fail_on
    rank = verdict_rank(verdict)
    return (F.when(fail_on == "never", 0)
            .when(fail_on == "block", F.when(verdict == "block", rank).otherwise(0))
            .otherwise(rank))


# --- measured truth ----------------------------------------------------------
def block_of_level(level: Column) -> Column:
    """What a held lock level blocks: reads, writes or none."""
    return (F.when(level == 8, "reads").when(level.isin(5, 6, 7), "writes").otherwise("none"))


def mode_level(pg_mode: Column) -> Column:
    """Lock level of a ``pg_locks`` mode spelling, NULL when it is not a table mode."""
    levels = {spelling: level for _, _, level, spelling in tables.LOCK_MODES if spelling}
    return F.try_element_at(literal_map(levels), pg_mode)


def mode_name(level: Column) -> Column:
    names = [mode for mode, _, _, _ in tables.LOCK_MODES]
    return F.try_element_at(F.array(*[F.lit(n) for n in names]), (level + 1).cast("int"))


def conflict_mask(level: Column) -> Column:
    """Bit set (bit n = level n) of the modes a lock level conflicts with."""
    masks = tables.conflict_masks()
    return F.try_element_at(F.array(*[F.lit(masks[n]) for n in sorted(masks)]),
                            (level + 1).cast("int"))


def truth(error: Column, level: Column, hold_ms: Column, is_dml: Column, rows: Column,
          irreversible: Column) -> Column:
    """``struct<tier, block, proximity>``: the label a measured run earned."""
    block = block_of_level(F.coalesce(level, F.lit(0)))
    row_level = F.coalesce(level.isin(2, 3), F.lit(False)) | (
        is_dml & (F.coalesce(rows, F.lit(0)) > 0))
    lines = F.when(block == "none", "writes").otherwise(block)
    banded = (block != "none") | row_level
    tier = (
        F.when(error, "unsafe")
        .when(~banded, F.when(irreversible, "safe_irreversible").otherwise("safe"))
        .when(threshold_tier(hold_ms, lines) == "safe",
              F.when(block == "reads", "needs_timing")
              .when(irreversible, "safe_irreversible").otherwise("safe"))
        .otherwise(threshold_tier(hold_ms, lines))
    )
    return F.struct(tier.alias("tier"), F.when(error, "none").otherwise(block).alias("block"),
                    F.when(~error & banded, proximity(hold_ms, lines)).alias("proximity"))


def proximity(hold_ms: Column, block: Column) -> Column:
    """Hold over its nearest threshold; the short line wins a tie."""
    short, long = short_ms(block), long_ms(block)
    nearest = F.when(F.abs(hold_ms - short) <= F.abs(hold_ms - long), short).otherwise(long)
    return hold_ms.cast("double") / nearest


def outcome(predicted: Column, true_tier: Column) -> Column:
    ladder = literal_map(tables.LADDER)
    return (F.when(predicted == "unknown", "unknown")
            .when(predicted == true_tier, "match")
            .when(F.try_element_at(ladder, predicted) < F.try_element_at(ladder, true_tier),
                  "lenient").otherwise("strict"))


def normalized_hold(work_ms: Column, wait_ms: Column, factor: Column) -> Column:
    """Work scaled to the reference machine (half to even) plus the raw wait."""
    factor = F.when(factor <= 0, 1.0).otherwise(factor)
    return F.bround(work_ms / factor).cast("bigint") + wait_ms
