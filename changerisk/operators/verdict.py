"""Verdict rules: five action tiers per statement part, then per statement.

Each step adds a few plain columns, so the long decision ladders stay in
separate projections and nothing here shuffles until parts are combined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.functions import durations as du
from changerisk.functions import tiers
from changerisk.functions.facts import has
from changerisk.operators.narrow import narrow_action
from changerisk.operators.rules import READ_BIT, WRITE_BIT
from changerisk.seeds import literal_map, tables
from changerisk.session import broadcast_if_small

NARROW_TYPE = ("struct<outcome:string,method:string,reason:string,condition:string,"
               "extra_relation:string,extra_level:int,family:string,relabel:boolean,"
               "rebuilds:array<string>>")
VERDICT_TYPE = ("struct<tier:string,method:string,band:string,rationale:string,"
                "conditions:array<string>,refusal:string,refused_from:string>")


def verdict(tier: Column | str, method: Column | str, rationale: Column | str,
            band: Column | None = None, condition: Column | str | None = None,
            refusal: str | None = None, refused_from: Column | None = None) -> Column:
    given = {"tier": tier, "method": method, "band": band, "rationale": rationale,
             "refusal": refusal, "refused_from": refused_from}

    def text(value: object) -> str:
        return "cast(NULL AS string)" if value is None or isinstance(value, Column) \
            else "'" + str(value).replace("'", "\\'") + "'"

    said = [] if condition is None or isinstance(condition, Column) else [text(condition)]
    conditions = f"array({said[0]})" if said else "cast(array() AS array<string>)"
    # one parsed expression; the computed fields replace their constants
    out = F.expr("named_struct(" + ", ".join(
        f"'{name}', {conditions if name == 'conditions' else text(given[name])}"
        for name in ("tier", "method", "band", "rationale", "conditions", "refusal",
                     "refused_from")) + ")")
    for name, value in given.items():
        if isinstance(value, Column):
            out = out.withField(name, value)
    if isinstance(condition, Column):
        out = out.withField("conditions", F.array_compact(F.array(condition)))
    return out


def block_type(locks: Column) -> Column:
    """What the certain locks block: reads, writes, or NULL."""
    return (F.when(F.exists(locks, lambda k: k["certain"] & k["blocks_reads"]), "reads")
            .when(F.exists(locks, lambda k: k["certain"] & k["blocks_writes"]), "writes"))


def _refused(would_be: Column, band: Column, method: Column) -> Column:
    return verdict("unknown", method, "too near a threshold: the machine decides on which side",
                   band, "time the statement on a copy before deciding", "boundary", would_be)


def proportional_verdict(estimate: Column, block: Column, live_exclusive: Column,
                         base_method: Column, spread: Column) -> Column:
    """Refusal, then the threshold tier of the upper bound."""
    band = du.band(estimate["high_ms"])
    method = tiers.weakest(base_method, F.coalesce(estimate["method"], F.lit("unverified")))
    tier = tiers.threshold_tier(estimate["high_ms"], block)
    line = tiers.boundary_refusal(estimate["point_ms"], spread, block,
                                  ~((block == "reads") & live_exclusive))
    return (
        F.when(block.isNull(), verdict("safe", base_method, "no reader and no writer has to wait",
                                       band))
        .when(estimate["refusal"].isNotNull(), verdict(
            "unknown", "unverified", F.concat(
                F.lit("blocks "), block, F.lit(" for a time that could not be estimated: "),
                estimate["refusal"])))
        .when(line.isNotNull(), _refused(tier, band, method))
        .when(tier == "needs_timing", verdict(
            tier, method, F.concat(F.lit("blocks "), block, F.lit(" while it runs")), band,
            "run in a quiet window or with a short lock_timeout and retries"))
        .otherwise(verdict(tier, method, F.concat(F.lit("blocks "), block,
                                                  F.lit(" while it runs")), band))
    )


def constant_verdict(block: Column, method: Column) -> Column:
    """A catalog-only change: only its lock matters."""
    band = F.lit("sub_second")
    return (
        F.when(block == "reads", verdict(
            "needs_timing", method, "catalog-only, but its lock stops reads and writes", band,
            "acquire promptly: set lock_timeout with retries or use a quiet window"))
        .otherwise(verdict("safe", method, "catalog-only", band))
    )


def matched_dml_verdict(worst: Column, batched: Column) -> Column:
    """A WHERE clause of unknown reach, bounded by the whole table."""
    method = tiers.weakest(F.lit("proven"), F.coalesce(worst["method"], F.lit("unverified")))
    band = du.band(worst["high_ms"])
    advice = F.when(batched, F.lit("keep the matched rows bounded")).otherwise(
        F.lit("keep the matched rows bounded; consider batching"))
    return (
        F.when(worst["refusal"].isNotNull(), verdict(
            "unknown", "unverified", F.concat(
                F.lit("row locks only, but neither matches nor table size are known: "),
                worst["refusal"])))
        .when(worst["high_ms"] < tables.WRITES_SHORT_MS,
              verdict("safe", method, "row locks only, brief even if every row matched", band))
        .otherwise(verdict("needs_timing", method,
                           "row locks only; the matched rows are not known", band, advice))
    )


def all_rows_verdict(estimate: Column, spread: Column) -> Column:
    """An UPDATE or DELETE of every row, held to the write lines."""
    block = F.lit("writes")
    band, tier = du.band(estimate["high_ms"]), tiers.threshold_tier(estimate["high_ms"], block)
    line = tiers.boundary_refusal(estimate["point_ms"], spread, block, F.lit(True))
    return (
        F.when(estimate["refusal"].isNotNull(), verdict(
            "unknown", "unverified", F.concat(F.lit("every row changes and the size is unknown: "),
                                              estimate["refusal"])))
        .when(line.isNotNull(), _refused(tier, band, estimate["method"]))
        .when(tier == "needs_timing", verdict(
            tier, estimate["method"], "every row is locked in one transaction", band,
            "only in a quiet window; prefer batches"))
        .otherwise(verdict(tier, estimate["method"], "every row is locked in one transaction",
                           band))
    )


@dataclass
class Snapshot:
    """Catalog facts of many databases; every table is keyed by ``db_id``.

    ``servers`` is required, the others may be None (their facts are then
    missing). See :mod:`changerisk.schemas` for the columns.
    """

    servers: DataFrame
    relations: DataFrame | None = None
    types: DataFrame | None = None
    type_changes: DataFrame | None = None
    functions: DataFrame | None = None
    waiters: DataFrame | None = None


def duration_relation() -> Column:
    """The relation whose size decides how long a part runs."""
    return F.when(F.col("kind") == "attach_partition", F.col("action.partition")).otherwise(
        F.try_element_at("targets", F.lit(1)))


def add_estimates(units: DataFrame, online: bool, rates: du.RateTable) -> DataFrame:
    """Add ``worst`` (whole-relation rows), ``bytes_worst`` and ``rebuild_worst``.

    Needs ``facts``, ``sizing`` and ``relation_state``. A relation this file
    created empty costs a fixed moment; one it bulk-loaded cannot be sized.
    """
    state, name = F.col("relation_state"), F.col("size_relation")
    family = F.coalesce(F.col("narrow.family"), du.rows_family(
        F.col("kind"), F.col("index_method"), F.col("has_expression")))
    offline = du.refuse(F.lit("no live snapshot: the row count is unknown"))
    absent = du.refuse(F.lit("the relation was not captured in the snapshot"))

    def sized(estimate: Column, family_: Column, clean: bool = True) -> Column:
        out = F.when(name.isNull(), du.refuse(
            F.lit("the statement names no relation to size the work by")))
        if clean:
            out = out.when(state == "clean", du.fixed_cost("proven")).when(
                state == "loaded", du.refuse(F.lit("this file filled the table before")))
        if not online:
            return out.otherwise(offline)
        return (out.when(family_.isNull(), du.refuse(
            F.concat(F.lit("no throughput constant is defined for "), F.col("kind"))))
            .when(F.col("facts").isNull(), absent).otherwise(estimate))

    staged = units.withColumn("__family", family)
    if not online:
        return staged.withColumn("worst", sized(offline, F.col("__family"))).withColumn(
            "bytes_worst", sized(offline, F.col("__family"), clean=False)).withColumn(
            "rebuild_worst", offline).drop("__family")
    size = F.col("facts.size_bytes")
    by_bytes = F.when(has(size) & size["value"].isNotNull(), du.estimate_bytes(
        size["value"], F.col("sizing.factor"), du.bytes_family(F.col("kind")), rates)).otherwise(
        du.refuse(F.concat(F.lit("size unavailable: "), F.coalesce(size["reason"], F.lit("")))))
    rebuild = (F.when(state == "clean", du.fixed_cost("proven"))
               .when(F.col("facts").isNull(), absent)
               .otherwise(du.estimate_rebuilds(F.col("sizing"), F.col("narrow.rebuilds"), rates)))
    return (
        staged.withColumn("worst", sized(du.estimate_rows(
            F.col("sizing"), F.col("__family"), rates), F.col("__family")))
        .withColumn("bytes_worst", sized(by_bytes, du.bytes_family(F.col("kind")), clean=False))
        .withColumn("rebuild_worst", rebuild).drop("__family")
    )


def add_narrowing(units: DataFrame) -> DataFrame:
    """Add ``narrow`` from the joined facts, and the locks they reveal."""
    narrow = F.when(F.col("rule.live") & F.col("is_action"), narrow_action(
        F.col("kind"), F.col("action"), F.col("facts"), F.col("type_facts"), F.col("change"),
        F.col("live_functions"), F.col("pg_version"), F.try_element_at("targets", F.lit(1))))
    staged = units.withColumn("narrow", narrow)
    mask = tiers.conflict_mask(F.col("narrow.extra_level"))
    extra = F.struct(
        F.lit("referenced_table").alias("role"), F.col("narrow.extra_relation").alias("relation"),
        F.col("narrow.extra_level").alias("level"),
        (mask.bitwiseAND(READ_BIT) != 0).alias("blocks_reads"),
        (mask.bitwiseAND(WRITE_BIT) != 0).alias("blocks_writes"), F.lit(True).alias("certain"))
    return staged.withColumn("all_locks", F.when(
        F.col("narrow.extra_level").isNotNull(),
        F.concat("locks", F.array(extra))).otherwise(F.col("locks")))


def add_row_verdicts(units: DataFrame, online: bool, rates: du.RateTable) -> DataFrame:
    """Add ``duration`` and ``verdict`` per part; the branch order is the rule order."""
    rule, kind = F.col("rule"), F.col("kind")
    staged = units.withColumn("block", block_type(F.col("all_locks")))
    block, live_ax = F.col("block"), F.col("live_exclusive")
    proven = F.lit("proven")
    generic_duration = (
        F.when(rule["duration"] == "constant", du.fixed_cost("proven"))
        .when(rule["duration"] == "index_bytes", F.col("bytes_worst"))
        .when(rule["duration"] == "rows", F.col("worst"))
        .otherwise(du.refuse(F.lit("rows matched by the statement are not known"))))
    narrowed = F.col("narrow")
    uncalibrated = ((rule["level"] == 9) | (rule["duration"] == "unknown")
                    | ~rule["calibrated"])
    forbidden = (rule["txn"] == "forbidden") & (F.col("explicit") | F.col("in_block"))
    live_gap = F.lit("no live snapshot: the rule is a worst case needing live context"
                     if not online else
                     "the snapshot could not supply the declared live context")
    branch = (
        F.when(F.col("empty"), "empty")
        .when(rule.isNull(), "no_rule")
        .when(~rule["available"], "unavailable")
        .when(uncalibrated, "uncalibrated")
        .when(forbidden, "forbidden")
        .when(F.col("file_local"), "file_local")
        .when(kind.isin(*tables.PURE_READS), "read")
        .when(kind.isin(*tables.LOADING_CREATES), "loading_create")
        .when((kind == "insert") & (rule["duration"] == "matched_rows"), "insert_select")
        .when(kind.isin(*tables.DML_MATCHED), "matched_dml")
        .when(kind.isin(*tables.DML_ALL_ROWS), "all_rows_dml")
        .when(rule["live"], F.when(narrowed.isNull(), "live_unresolved")
              .when(narrowed["outcome"] == "unresolved", "live_unresolved")
              .when(narrowed["outcome"] == "constant", "live_constant")
              .when(narrowed["outcome"] == "keep_model", "generic")
              .otherwise("live_proportional"))
        .otherwise("generic"))
    staged = staged.withColumn("branch", branch)
    b = F.col("branch")
    file_duration = (
        F.when(rule["duration"] == "constant", du.fixed_cost("proven"))
        .when(F.col("relation_state") == "loaded",
              du.refuse(F.lit("this file filled the table before")))
        .otherwise(du.fixed_cost("proven")))
    duration = (
        F.when(b == "file_local", file_duration)
        .when(b == "all_rows_dml", F.col("worst"))
        .when(b == "live_constant", du.fixed_cost(narrowed["method"]))
        .when(b == "live_proportional", F.when(F.size(narrowed["rebuilds"]) > 0,
                                               F.col("rebuild_worst"))
              .otherwise(F.col("worst")))
        .when(b == "generic", generic_duration)
        .when(b.isin("unavailable", "forbidden", "read"), du.refuse(b, "proven"))
        .otherwise(du.refuse(b)))
    staged = staged.withColumn("duration", duration)
    d = F.col("duration")
    spread = rates.spread(d["constant_key"])
    sized = proportional_verdict(
        d, block, live_ax, F.when(b == "live_proportional", tiers.weakest(
            proven, F.coalesce(narrowed["method"], F.lit("unverified")))).otherwise(proven),
        spread)
    sizes = (b == "live_proportional") | ((b == "generic")
                                          & rule["duration"].isin("rows", "index_bytes"))
    batched = kind.endswith("_batched")
    first = (
        F.when(b == "empty", verdict("unknown", "unverified", F.when(
            F.col("statement_kind") == "do_block",
            F.lit("the DO block yielded no analyzable inner statements")).otherwise(
            F.lit("no rule applies to the statement"))))
        .when(b == "no_rule", verdict("unknown", "unverified",
                                      "no rule applies to the statement"))
        .when(b == "unavailable", verdict("unsafe", "proven",
                                          "the form does not exist on this version: it fails"))
        .when(b == "uncalibrated", verdict("unknown", "unverified", F.when(
            rule["level"] == 9, F.lit("the statement form is not modeled")).otherwise(
            F.lit("the rule is an uncalibrated stub"))))
        .when(b == "forbidden", verdict("unsafe", "proven",
                                        "it cannot run inside a transaction block: it fails"))
        .when(b == "file_local", verdict("safe", "proven",
                                         "it touches only relations this file creates",
                                         du.band(d["high_ms"])))
        .when(b == "read", verdict("safe", "proven", "it only reads"))
        .when(b == "loading_create", verdict(
            "needs_timing", "proven", "a new object, filled by a query of unknown volume",
            condition="the defining query bounds the runtime"))
        .when(b == "insert_select", verdict(
            "needs_timing", "proven", "blocks nothing, but its volume follows the source query",
            condition="the source query bounds the runtime"))
        .when(b == "matched_dml", matched_dml_verdict(F.col("worst"), batched))
        .when(b == "all_rows_dml", all_rows_verdict(d, spread))
        .when(b == "live_unresolved", verdict("unknown", "unverified", F.when(
            narrowed["reason"].isNotNull(), F.concat(live_gap, F.lit(": "), narrowed["reason"])
            ).otherwise(live_gap)))
        .when(sizes, sized)
        .when((b == "live_constant") | (rule["duration"] == "constant"), constant_verdict(
            block, F.when(b == "live_constant", tiers.weakest(
                proven, F.coalesce(narrowed["method"], F.lit("unverified")))).otherwise(proven)))
        .otherwise(verdict("unknown", "unverified", "grows with the number of rows that match"))
    )
    return staged.withColumn("verdict", first)


def _retier(column: Column, tier: Column, condition: Column | None = None,
            method: Column | None = None) -> Column:
    out = column.withField("tier", tier)
    if method is not None:
        out = out.withField("method", method)
    if condition is not None:
        out = out.withField("conditions", F.concat(F.array(condition), column["conditions"]))
    return out


def cap_conditional_branch(v: Column, condition: Column) -> Column:
    """A condition that avoids the costly branch makes the statement a timing question."""
    hit = condition.isNotNull() & v["tier"].isin("needs_timing", "unsafe")
    return F.when(hit, _retier(v, F.lit("needs_timing"), condition)).otherwise(v)


def escalate_for_contention(v: Column, observed: Column, active: Column) -> Column:
    """Seen lock traffic lifts safe tiers, and a timed one to unsafe when it is active."""
    tier = F.when(tiers.is_safe(v["tier"]), "needs_timing").when(
        (v["tier"] == "needs_timing") & active, "unsafe")
    hit = observed & tier.isNotNull() & ~v["tier"].isin("unknown", "unsafe")
    return F.when(hit, _retier(v, tier, method=tiers.weakest(v["method"], F.lit("observed")))
                  ).otherwise(v)


def floor_for_exclusive(v: Column, live_exclusive: Column) -> Column:
    """Acquiring ACCESS EXCLUSIVE on an older relation is never simply safe."""
    return F.when(tiers.is_safe(v["tier"]) & live_exclusive, _retier(
        v, F.lit("needs_timing"),
        F.lit("acquire promptly: ACCESS EXCLUSIVE queues behind every open transaction"))
    ).otherwise(v)


def cap_for_guard(v: Column, conditional: Column) -> Column:
    """A statement behind an existence check may not run at all."""
    guard = F.when(v["tier"] == "unsafe", F.lit("guarded; unsafe if the guard passes")).otherwise(
        F.lit("runs only if a catalog check says so"))
    return F.when(conditional & (v["tier"] != "unknown"),
                  _retier(v, F.lit("needs_timing"), guard)).otherwise(v)


def adjust_row_verdicts(units: DataFrame) -> DataFrame:
    """Condition cap, contention, exclusive floor and guard cap, in that order."""
    v = F.col("verdict")
    out = units.withColumn("verdict", cap_conditional_branch(v, F.col("narrow.condition")))
    out = out.withColumn("verdict", escalate_for_contention(
        v, F.col("contended"), F.col("contention_active")))
    out = out.withColumn("verdict", floor_for_exclusive(v, F.col("live_exclusive")))
    return out.withColumn("verdict", cap_for_guard(v, F.col("conditional")))


# --- contention ---------------------------------------------------------------
def waiter_masks(waiters: DataFrame) -> DataFrame:
    """Lock traffic per relation as two bit sets: modes seen, modes seen active.

    Bit n is lock level n; bit 0 collects unknown mode names, which conflict
    with everything. A waiter is idle only when all its blockers are known to
    be idle in transaction.
    """
    modes = F.concat("blocking_modes", F.array("blocked_mode"))
    idle = has(F.col("all_idle")) & F.coalesce(F.col("all_idle.value"), F.lit(False))
    seen = waiters.select("db_id", "relation", idle.alias("idle"), F.explode(modes).alias("m"))
    levels = {s: 1 << n for _, _, n, s in tables.LOCK_MODES if s}
    bit = F.coalesce(F.try_element_at(literal_map(levels), F.col("m")), F.lit(1))
    return seen.groupBy("db_id", "relation").agg(
        F.bit_or(bit).alias("seen_mask"),
        F.coalesce(F.bit_or(F.when(~F.col("idle"), bit)), F.lit(0)).alias("active_mask"))


def relation_contention(locks: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """``contended`` and ``active`` per key from ``locks(db_id, relation, level)``."""
    joined = locks.join(broadcast_if_small(masks), ["db_id", "relation"], "left")
    against = tiers.conflict_mask(F.col("level")).bitwiseOR(F.lit(1))

    def hits(column: str) -> Column:
        return F.coalesce(F.col(column).bitwiseAND(against) != 0, F.lit(False))

    return joined.groupBy(*keys).agg(F.bool_or(hits("seen_mask")).alias("contended"),
                                     F.bool_or(hits("active_mask")).alias("contention_active"))


# --- statements ------------------------------------------------------------------
def part_undo(units: DataFrame) -> DataFrame:
    """Add ``undo``: what reversing the part takes and what is lost."""
    lost = F.try_element_at(literal_map(tables.LOST), F.col("kind"))
    relabelled = F.coalesce(F.col("narrow.relabel"), F.lit(False))
    state = F.when(relabelled, "reversible").otherwise(
        F.coalesce(F.col("rule.undo"), F.lit("unknown")))
    return units.withColumn("undo", F.struct(
        state.alias("reversibility"), F.when(state == "irreversible", lost).alias("lost"),
        F.when(relabelled, "observed").when(state == "unknown", "unverified")
        .otherwise("proven").alias("method")))


def combine_statements(units: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """One verdict per statement: the worst part, the first among equals.

    Parts of a statement sit in the same task, so the aggregate collapses them
    before its shuffle.
    """
    rank = tiers.tier_rank(F.col("verdict.tier"))
    undo_rank = F.try_element_at(literal_map(tables.UNDO_RANK), F.col("undo.reversibility"))
    place = [F.col("inner_pos"), F.col("action_pos")]
    real = ~F.col("empty")
    fixed = F.coalesce(F.col("duration.constant_key") == "constant_op", F.lit(False))
    level = F.col("rule.level")
    part = F.struct("verdict", "kind", "duration")
    grouped = units.groupBy(*keys).agg(
        F.min_by(part, F.struct(F.col("empty"), -rank, *place)).alias("deciding"),
        F.min_by("undo", F.struct(F.col("empty"), -undo_rank, *place)).alias("undo"),
        F.coalesce(F.max(F.when(level.between(1, 8), level)), F.lit(0)).alias("lock_level"),
        F.bool_and(fixed | ~real).alias("all_fixed_cost"),
        F.count_if(real).alias("parts"),
        F.bool_or("opaque").alias("opaque"),
        *[F.min_by(c, F.struct(*place)).alias(c) for c in carry],
    )
    v = F.col("deciding.verdict")
    hidden = F.col("opaque") & (v["tier"] != "unsafe")
    combined = F.when(hidden, verdict(
        "unknown", "unverified", "the DO block builds SQL at runtime")).otherwise(v)
    return grouped.select(
        *keys, *carry, combined.alias("verdict"), F.col("deciding.kind").alias("deciding_kind"),
        F.col("deciding.duration").alias("duration"), "undo", "lock_level",
        (F.col("all_fixed_cost") & (F.col("parts") > 0)).alias("all_fixed_cost"), "parts")


def finish_statements(statements: DataFrame) -> DataFrame:
    """Irreversible safe statements get their own tier; held locks come last.

    Needs ``blocking_held``. A long statement that is safe by itself still
    prolongs the blocking locks its transaction already holds.
    """
    v, undo = F.col("verdict"), F.col("undo")
    marked = statements.withColumn("verdict", F.when(
        (v["tier"] == "safe") & (undo["reversibility"] == "irreversible"),
        _retier(v, F.lit("safe_irreversible"), F.concat(
            F.lit("no undo once committed: "), F.coalesce(undo["lost"], F.lit("state is lost"))),
            tiers.weakest(v["method"], undo["method"]))).otherwise(v))
    held = F.col("blocking_held") & ~F.col("all_fixed_cost") & (F.col("parts") > 0)
    return marked.withColumn("verdict", F.when(held & tiers.is_safe(v["tier"]), _retier(
        v, F.lit("needs_timing"),
        F.lit("the transaction keeps blocking locks while this runs"))).otherwise(v))


def invalid_index_note(index_name: Column, invalid: Column) -> Column:
    """What an invalid leftover index means for a CREATE INDEX, NULL when nothing."""
    return (F.when(F.array_contains(invalid, index_name), "an invalid index has this name")
            .when(F.size(invalid) > 0, "the table carries invalid indexes"))
