"""Rule resolution: which lock a statement or ALTER TABLE action takes.

The rule dimension is folded to one row per (kind, server version) holding its
candidate variants, so resolving is one broadcast equi join and a pick inside
the row: no range join, no shuffle and no row explosion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.functions.tiers import conflict_mask
from changerisk.seeds import tables
from changerisk.session import broadcast_if_small

READ_BIT, WRITE_BIT = 1 << 1, 1 << 3  # ACCESS SHARE, ROW EXCLUSIVE

_RULE_FIELDS = ("rule_ord", "level", "blocks_reads", "blocks_writes", "rewrite", "duration",
                "available", "calibrated", "live", "txn", "write_scope", "affected", "undo")


def explode_units(statements: DataFrame) -> DataFrame:
    """One row per assessable part: a statement, or each action of an ALTER TABLE.

    A statement without parts (an ALTER TABLE without actions, or a block,
    whose inner statements are rows of their own) stays as one ``empty`` row.
    """
    composite = F.col("kind").isin(*tables.COMPOSITE_KINDS)
    acted = statements.select("*", F.posexplode_outer(
        F.when(F.col("kind") == "alter_table", F.col("actions"))).alias("action_pos", "action"))
    return acted.select(
        *[c for c in statements.columns if c not in ("actions", "kind")],
        F.col("kind").alias("statement_kind"),
        F.coalesce(F.col("action.kind"), F.col("kind")).alias("kind"),
        F.col("action").isNotNull().alias("is_action"),
        (composite & F.col("action").isNull()).alias("empty"),
        F.coalesce(F.col("action_pos"), F.lit(0)).alias("action_pos"),
        F.col("action"),
    )


def index_rules(rules: DataFrame) -> DataFrame:
    """One row per (is_action, kind, version) with its variants in matching order."""
    versions = F.explode(F.sequence("lo", "hi")).alias("pg_version")
    is_default = (F.size("when") == 0).alias("is_default")
    rows = rules.select("is_action", "kind", versions, F.struct(
        is_default, *[F.col(f) for f in _RULE_FIELDS if f == "rule_ord"],
        F.map_entries("when").alias("when"),
        *[F.col(f) for f in _RULE_FIELDS if f != "rule_ord"]).alias("variant"))
    return rows.groupBy("is_action", "kind", "pg_version").agg(
        F.array_sort(F.collect_list("variant"), _variant_order).alias("variants"))


def _variant_order(a: Column, b: Column) -> Column:
    def key(v: Column) -> Column:
        return v["is_default"].cast("int") * 1_000_000 + v["rule_ord"]

    return key(a) - key(b)


def when_matches(when: Column, attrs: Column) -> Column:
    """Every key of a ``when`` condition is present with one of its values."""
    return F.forall(when, lambda e: F.coalesce(
        F.array_contains(e["value"], F.try_element_at(attrs, e["key"])), F.lit(False)))


def apply_rules(units: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule``, the first matching variant of the unit's kind and version."""
    index = broadcast_if_small(index_rules(rules))
    joined = units.join(index, ["is_action", "kind", "pg_version"], "left")
    chosen = F.filter("variants", lambda v: when_matches(v["when"], F.col("attrs")))
    return joined.withColumn("rule", F.when(~F.col("empty"), F.try_element_at(
        chosen, F.lit(1)))).drop("variants")


def _names_for(role: Column) -> Column:
    """Relation names the statement supplies for a role."""
    targets = F.coalesce(F.col("targets"), F.array().cast("array<string>"))

    def one(name: Column) -> Column:
        return F.array_compact(F.array(name))

    return (
        F.when(role == "target", F.slice(targets, 1, 1))
        .when(role == "additional_targets",
              F.slice(targets, F.lit(2), F.greatest(F.size(targets) - 1, F.lit(0))))
        .when(role == "referenced_table", one(F.col("action.referenced_table")))
        .when(role == "referenced_tables",
              F.coalesce(F.col("referenced_tables"), F.array().cast("array<string>")))
        .when(role == "partition", one(F.col("action.partition")))
        .when(role == "parent", one(F.col("partition_of")))
        .otherwise(F.array(F.lit(None).cast("string")))
    )


def expand_locks(units: DataFrame) -> DataFrame:
    """Add ``locks``: one entry per relation lock the resolved rule takes.

    Roles no statement can name give one unnamed entry. ``missing_role`` holds
    the required role the statement failed to supply, NULL when all are there.
    """
    def entries(role: Column) -> Column:
        mask = conflict_mask(role["level"])
        return F.transform(_names_for(role["role"]), lambda name: F.struct(
            role["role"].alias("role"), name.alias("relation"),
            role["level"].alias("level"),
            (mask.bitwiseAND(READ_BIT) != 0).alias("blocks_reads"),
            (mask.bitwiseAND(WRITE_BIT) != 0).alias("blocks_writes"),
            (role["resolvable"] | ~role["optional"]).alias("certain")))

    missing = F.filter("rule.affected", lambda r: r["resolvable"] & ~r["optional"]
                       & (F.size(_names_for(r["role"])) == 0))
    return units.select(
        "*",
        F.flatten(F.transform("rule.affected", entries)).alias("locks"),
        F.try_element_at(missing, F.lit(1))["role"].alias("missing_role"),
    )


def statement_lock_levels(units: DataFrame, keys: list[str]) -> DataFrame:
    """Strongest lock per statement.

    ``lock_level`` ignores rows without a table lock; ``strictest_level`` keeps
    an unknown lock as the strongest of all.
    """
    level = F.col("rule.level")
    return units.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(level.between(1, 8), level)), F.lit(0)).alias("lock_level"),
        F.coalesce(F.max(level), F.lit(0)).alias("strictest_level"),
    )


def distinct_relations(units: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (relation, role, level) of each statement with the first position."""
    position = F.struct("inner_pos", "action_pos", "lock_pos")
    locks = units.select(*keys, "inner_pos", "action_pos",
                         F.posexplode("locks").alias("lock_pos", "lock"))
    return (locks.groupBy(*keys, F.col("lock.relation"), F.col("lock.role"),
                          F.col("lock.level"))
            .agg(F.min(position).alias("first_at"),
                 F.max("lock.certain").alias("certain")))


def blocked_behind(level: Column) -> Column:
    """What queues behind a lock: reads, writes, maintenance, or ddl only."""
    mask = conflict_mask(level)

    def part(bit: int, name: str) -> Column:
        return F.when(mask.bitwiseAND(bit) != 0, name)

    parts = F.array_compact(F.array(part(READ_BIT, "reads"), part(WRITE_BIT, "writes"),
                                    part(1 << 4, "maintenance")))
    return F.when(F.size(parts) == 0, "exclusive ddl").otherwise(F.array_join(parts, ", "))


# --- checks on a rule table -------------------------------------------------
def coverage_gaps(rules: DataFrame, lo: int = tables.VERSION_MIN,
                  hi: int = tables.VERSION_MAX) -> DataFrame:
    """Versions of a kind not covered by exactly one default rule."""
    kinds = rules.select("is_action", "kind").distinct()
    domain = kinds.select("*", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("version"))
    covered = (rules.filter(F.size("when") == 0)
               .select("is_action", "kind", F.explode(F.sequence("lo", "hi")).alias("version"))
               .groupBy("is_action", "kind", "version").agg(F.count("*").alias("rules")))
    counted = domain.join(covered, ["is_action", "kind", "version"], "left")
    return (counted.select("is_action", "kind", "version",
                           F.coalesce("rules", F.lit(0)).alias("rules"))
            .filter(F.col("rules") != 1))


def overlapping_variants(rules: DataFrame) -> DataFrame:
    """Versions where two variants of a kind have the same condition.

    Counted per version instead of paired, so the output stays linear.
    """
    return (rules.filter(F.size("when") > 0)
            .select("is_action", "kind", F.to_json("when").alias("condition"),
                    F.explode(F.sequence("lo", "hi")).alias("version"))
            .groupBy("is_action", "kind", "condition", "version")
            .agg(F.count("*").alias("rules")).filter(F.col("rules") > 1))


def asymmetric_conflicts(conflicts: DataFrame) -> DataFrame:
    """Conflict pairs whose mirror is missing."""
    mirrored = conflicts.select(F.col("other").alias("mode"), F.col("mode").alias("other"))
    return conflicts.join(mirrored, ["mode", "other"], "left_anti").distinct()


def spanned_breakpoints(rules: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """Rules whose version range crosses a known behaviour change of their kind."""
    return (rules.join(broadcast_if_small(breakpoints), "kind")
            .filter((F.col("lo") < F.col("version")) & (F.col("version") <= F.col("hi")))
            .select("is_action", "kind", "lo", "hi", "version"))


def kinds_without_rules(units: DataFrame, rules: DataFrame) -> DataFrame:
    """Kinds seen in a corpus that no rule covers, with how often they occur."""
    seen = units.groupBy("is_action", "kind").agg(F.count("*").alias("occurrences"))
    known = broadcast_if_small(rules.select("is_action", "kind").distinct())
    return seen.join(known, ["is_action", "kind"], "left_anti")


def incoherent_flags(rules: DataFrame) -> DataFrame:
    """Rules whose blocking flags contradict the conflict matrix."""
    mask = conflict_mask(F.col("level"))
    reads, writes = mask.bitwiseAND(READ_BIT) != 0, mask.bitwiseAND(WRITE_BIT) != 0
    table_lock = F.col("level").between(1, 8)
    bad = (table_lock & ((F.col("blocks_reads") != reads) | (writes & ~F.col("blocks_writes"))))
    bad = bad | ((F.col("level") == 0) & (F.col("blocks_reads") | F.col("blocks_writes")))
    return rules.filter(bad).select("is_action", "kind", "lo", "hi", "level", "blocks_reads",
                                    "blocks_writes")
