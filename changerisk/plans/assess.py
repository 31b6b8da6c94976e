"""The assessment plan: tagged statements and catalog facts to verdicts.

One lazy plan over all files at once. Rules are a broadcast join; statements
are shuffled for their file's ordered state and once more per fact table that
is too large to broadcast; parts collapse inside their task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk import seeds
from changerisk.functions import durations as du
from changerisk.functions import tiers
from changerisk.functions.names import last_spelled
from changerisk.operators import order, rules, verdict
from changerisk.operators.verdict import Snapshot
from changerisk.schemas import RELATION_FACTS, TYPE_CHANGE_FACTS, TYPE_FACTS
from changerisk.session import (
    broadcast_if_small,
    cut_lineage,
)

# columns no later step reads
_SPENT = ["sql", "attrs", "actions", "type_facts", "change", "live_functions", "server_now",
          "probe", "new_name", "missing_ok", "referenced_tables", "partition_of", "index_name"]
UNIT = ["file_id", "idx", "inner_pos", "action_pos"]


@dataclass
class Assessment:
    """``parts`` has a row per statement part, ``statements`` one per statement."""

    parts: DataFrame
    statements: DataFrame


def resolve_units(statements: DataFrame, rule_table: DataFrame, pg_version: int | None = None,
                  servers: DataFrame | None = None) -> DataFrame:
    """Statement parts with transaction state, rule and locks."""
    grouped = order.transaction_state(statements)
    if servers is not None:
        grouped = grouped.join(broadcast_if_small(servers), "db_id", "left")
    else:
        grouped = grouped.withColumn("pg_version", F.lit(pg_version))
    units = rules.apply_rules(rules.explode_units(grouped), rule_table)
    return rules.expand_locks(units)


def _left_join(units: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of facts that are unique per key.

    Beyond the broadcast limit it is a shuffled join, whose heavy partitions,
    NULL keys among them, adaptive execution splits on the units' side.
    """
    return units.join(broadcast_if_small(facts), keys, "left")


def join_facts(units: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Add ``facts``, ``type_facts``, ``change`` and ``live_functions``; NULL when missing."""
    keyed = units.select(
        "*", F.col("size_relation").alias("__rel"),
        F.col("action.column_type").alias("__type"), F.col("action.column").alias("__col"),
        F.try_element_at("targets", F.lit(1)).alias("__target"))
    if snapshot.relations is not None:
        keyed = _left_join(keyed, snapshot.relations.select(
            "db_id", F.col("relation").alias("__rel"), "facts"), ["db_id", "__rel"])
    else:
        keyed = keyed.withColumn("facts", F.lit(None).cast(RELATION_FACTS))
    if snapshot.types is not None:
        keyed = _left_join(keyed, snapshot.types.select(
            "db_id", F.col("type_name").alias("__type"), "type_facts"), ["db_id", "__type"])
    else:
        keyed = keyed.withColumn("type_facts", F.lit(None).cast(TYPE_FACTS))
    if snapshot.type_changes is not None:
        keyed = _left_join(keyed, snapshot.type_changes.select(
            "db_id", F.col("relation").alias("__target"), F.col("column").alias("__col"),
            F.col("new_type").alias("__type"), "change"),
            ["db_id", "__target", "__col", "__type"])
    else:
        keyed = keyed.withColumn("change", F.lit(None).cast(TYPE_CHANGE_FACTS))
    keyed = keyed.drop("__rel", "__type", "__col", "__target")
    nothing = F.lit(None).cast("map<string,int>")
    if snapshot.functions is None:
        return keyed.withColumn("live_functions", nothing)
    return _join_functions(keyed, snapshot.functions)


def _join_functions(units: DataFrame, functions: DataFrame) -> DataFrame:
    """Map of the live ranks of the functions a default could not decide.

    Only parts with undecided functions are exploded, and a part names a
    handful, so the collected map stays small.
    """
    rank = seeds.lookup({"i": 1, "s": 2, "v": 4}, F.col("volatility.value"))
    known = functions.filter(F.col("volatility.available")).select(
        "db_id", F.col("function").alias("__fn"), rank.alias("__rank"))
    asked = units.filter(F.col("kind") == "add_column_default_unknown_volatility").select(
        *UNIT, "db_id", F.explode("action.unknown_functions").alias("__fn"))
    found = _left_join(asked, known, ["db_id", "__fn"]).filter(F.col("__rank").isNotNull())
    maps = found.groupBy(*UNIT).agg(F.map_from_entries(
        F.collect_set(F.struct("__fn", "__rank"))).alias("live_functions"))
    return units.join(maps, UNIT, "left")


def unit_state(statements: DataFrame, units: DataFrame,
               waiters: DataFrame | None) -> DataFrame:
    """Per part: state of its relations in the file, and observed contention."""
    lock = F.struct(F.lit("lock").alias("use"), F.col("lock.relation").alias("relation"),
                    F.col("lock.level").alias("level"), F.col("lock.certain").alias("certain"))
    locks = units.select(*UNIT, "db_id", F.explode("all_locks").alias("lock")).select(
        *UNIT, "db_id", lock.alias("n"))
    sizes = units.filter(F.col("size_relation").isNotNull()).select(
        *UNIT, "db_id", F.struct(
            F.lit("size").alias("use"), F.col("size_relation").alias("relation"),
            F.lit(0).alias("level"), F.lit(False).alias("certain")).alias("n"))
    named = (locks.unionByName(sizes).select(*UNIT, "db_id", "n.*")
             .filter(F.col("relation").isNotNull())
             .withColumn("name", last_spelled(F.col("relation"))))
    seen = order.created_state(statements, named)
    is_lock = F.col("use") == "lock"
    if waiters is None:
        seen = seen.withColumn("contended", F.lit(False)).withColumn(
            "contention_active", F.lit(False))
    else:
        masks = verdict.waiter_masks(waiters)
        seen = _left_join(seen, masks, ["db_id", "relation"])
        against = tiers.conflict_mask(F.col("level")).bitwiseOR(F.lit(1))
        table_lock = is_lock & F.col("level").between(1, 8)

        def hits(column: str) -> Column:
            return table_lock & F.coalesce(F.col(column).bitwiseAND(against) != 0, F.lit(False))

        seen = seen.withColumn("contended", hits("seen_mask")).withColumn(
            "contention_active", hits("active_mask"))
    created = F.col("state").isNotNull()
    return seen.groupBy(*UNIT).agg(
        F.coalesce(F.bool_and(F.when(is_lock & F.col("certain"), created)),
                   F.lit(True)).alias("all_created"),
        F.bool_or(is_lock & F.col("certain") & (F.col("level") == 8) & ~created).alias("live_ax"),
        F.max(F.when(F.col("use") == "size", F.col("state"))).alias("relation_state"),
        F.bool_or("contended").alias("contended"),
        F.bool_or("contention_active").alias("contention_active"))


def assess(statements: DataFrame, snapshot: Snapshot | None = None, *,
           pg_version: int | None = None, rule_table: DataFrame | None = None,
           rates: du.RateTable | None = None) -> Assessment:
    """Verdicts for every statement of every file.

    Without a snapshot a ``pg_version`` is needed, and whatever depends on
    size or state is unknown, never unsafe.
    """
    spark = statements.sparkSession
    rule_table = seeds.rules(spark) if rule_table is None else rule_table
    rates = du.RateTable() if rates is None else rates
    online = snapshot is not None
    # Tagging is costly, and file state, baseline and parts all read its result.
    statements = cut_lineage(statements)
    units = resolve_units(statements, rule_table, pg_version,
                          snapshot.servers if online else None)
    units = units.withColumn("size_relation", verdict.duration_relation())
    if online:
        units = verdict.add_narrowing(join_facts(units, snapshot))
        units = du.with_sizing(units)
        # What follows reads only the size of all the facts.
        units = units.withColumn("facts", F.when(F.col("facts").isNotNull(), F.struct(
            F.col("facts.size_bytes").alias("size_bytes"))))
    else:
        units = units.withColumn("narrow", F.lit(None).cast(verdict.NARROW_TYPE)).withColumn(
            "all_locks", F.col("locks"))
    # The steps below read the parts several times: write them once.
    units = cut_lineage(units.drop(*_SPENT))
    held = order.held_locks(units).select("file_id", "idx", "blocking_held")
    state = unit_state(statements, units.select(
        *UNIT, "db_id", "all_locks", "size_relation"), snapshot.waiters if online else None)
    baseline = order.baseline_files(statements).filter("baseline").select(
        "file_id", F.lit(True).alias("baseline"))
    units = _left_join(units.join(state, UNIT, "left"), baseline, ["file_id"])

    is_base = F.coalesce("baseline", F.lit(False))
    certain = F.filter("locks", lambda k: k["certain"] & k["level"].between(1, 8))
    all_created = F.coalesce("all_created", F.lit(True))
    unnamed_ax = F.exists("all_locks", lambda k: k["certain"] & (k["level"] == 8)
                          & k["relation"].isNull())
    flags = {
        "file_local": is_base | F.coalesce((F.size(certain) > 0) & F.forall(
            certain, lambda k: k["relation"].isNotNull()) & all_created, F.lit(False)),
        "live_exclusive": ~is_base & (F.coalesce("live_ax", F.lit(False))
                                      | F.coalesce(unnamed_ax, F.lit(False))),
        "relation_state": F.when(is_base, "clean").otherwise(F.col("relation_state")),
        "contended": F.coalesce("contended", F.lit(False)),
        "contention_active": F.coalesce("contention_active", F.lit(False)),
    }
    units = units.withColumns(flags)
    units = verdict.add_row_verdicts(verdict.add_estimates(units, online, rates), online, rates)
    parts = verdict.part_undo(verdict.adjust_row_verdicts(units))

    combined = verdict.combine_statements(parts, ["file_id", "idx"],
                                          ["statement_kind", "line", "db_id"])
    finished = verdict.finish_statements(
        combined.join(held, ["file_id", "idx"], "left")
        .withColumn("blocking_held", F.coalesce("blocking_held", F.lit(False))))
    return Assessment(parts, finished)
