"""The rule dimension, resolution and the conflict matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from changerisk import seeds
from changerisk.functions.tiers import conflict_mask
from changerisk.operators import rules
from changerisk.seeds import tables


def test_rule_tables_are_whole():
    rows = tables.rule_rows()
    assert sum(not r["is_action"] for r in rows) == 133
    assert sum(r["is_action"] for r in rows) == 82


def test_built_in_rules_pass_their_own_checks(spark):
    table = seeds.rules(spark)
    assert rules.coverage_gaps(table).isEmpty()
    assert rules.overlapping_variants(table).isEmpty()
    assert rules.spanned_breakpoints(table, seeds.breakpoints(spark)).isEmpty()
    assert rules.incoherent_flags(table).isEmpty()
    assert rules.asymmetric_conflicts(seeds.conflicts(spark)).isEmpty()


def test_conflict_masks_follow_the_matrix(spark):
    rows = spark.range(10).select(F.col("id").cast("int").alias("l"), conflict_mask(
        F.col("id").cast("int")).alias("m")).collect()
    masks = {r["l"]: r["m"] for r in rows}
    assert masks[0] == 0
    assert masks[1] == 1 << 8  # ACCESS SHARE waits for ACCESS EXCLUSIVE only
    assert masks[8] == masks[9] == sum(1 << n for n in range(1, 9))
    assert masks[5] & (1 << 3) and not masks[5] & (1 << 1)  # SHARE stops writers, not readers


def test_variants_win_over_the_default_row(spark):
    units = spark.sql("""
        SELECT 'f' file_id, 0L idx, 0 inner_pos, 0 action_pos, 17 pg_version, false is_action,
               false empty, kind, map_from_arrays(array(k), array(v)) attrs
        FROM VALUES ('insert', 'source', 'values'), ('insert', 'source', 'select'),
                    ('reindex', 'scope', 'index'), ('reindex', 'scope', 'schema'),
                    ('lock_table', 'mode', '5'), ('create_index', 'x', 'y') AS t(kind, k, v)""")
    found = rules.apply_rules(units, seeds.rules(spark)).select(
        "kind", F.map_values("attrs")[0].alias("v"), "rule.level", "rule.duration").collect()
    got = {(r["kind"], r["v"]): (r["level"], r["duration"]) for r in found}
    assert got == {
        ("insert", "values"): (3, "constant"), ("insert", "select"): (3, "matched_rows"),
        ("reindex", "index"): (8, "index_bytes"), ("reindex", "schema"): (5, "rows"),
        ("lock_table", "5"): (5, "constant"), ("create_index", "y"): (5, "rows")}
