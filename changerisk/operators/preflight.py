"""What a change would do to the data: checks that run over whole tables.

The reference point is the server's own behaviour: a foreign key passes when
any of its columns is NULL, a check passes when its condition is NULL, unique
keys treat NULLs as distinct.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.functions.durations import int_div
from changerisk.operators.distribution import prefix_scan
from changerisk.session import broadcast_if_small, cut_lineage


def _all(tests: list[Column]) -> Column:
    return reduce(and_, tests)


# --- constraints ----------------------------------------------------------------
def orphan_keys(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Foreign keys without a parent, with the number of child rows of each.

    Child rows are counted per key before the shuffle, so a key that a third
    of the table shares reaches the join as one row per task.
    """
    keys = list(on)
    used = child.filter(_all([F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(
        F.count("*").alias("rows"))
    known = parent.select(*[F.col(p).alias(c) for c, p in on.items()])
    return used.join(known, keys, "left_anti")


def orphan_rows(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """The child rows behind :func:`orphan_keys`, whole."""
    missing = orphan_keys(child, parent, on).drop("rows")
    return child.join(broadcast_if_small(missing), list(on), "left_semi")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null count of many columns in one pass: one row per column."""
    counts = F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()
                                                                     ).alias("nulls"))
                       for c in columns])
    return df.agg(F.count("*").alias("rows"), counts.alias("c")).select(
        "rows", F.inline("c")).select("column", "nulls", "rows")


def check_violations(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false; an unknown condition passes."""
    return df.filter(~condition)


def duplicate_keys(df: DataFrame, keys: list[str], predicate: Column | None = None,
                   nulls_distinct: bool = True) -> DataFrame:
    """Keys a unique index would reject, with their row count."""
    rows = df if predicate is None else df.filter(predicate)
    if nulls_distinct:
        rows = rows.filter(_all([F.col(k).isNotNull() for k in keys]))
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def primary_key_problems(df: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicate keys and rows with a null key part, counted."""
    null_part = reduce(or_, [F.col(k).isNull() for k in keys])
    groups = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    return groups.agg(
        F.coalesce(F.sum(F.when(null_part, F.col("rows"))), F.lit(0)).alias("null_rows"),
        F.count_if(~null_part & (F.col("rows") > 1)).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(~null_part & (F.col("rows") > 1), F.col("rows"))), F.lit(0)
                   ).alias("duplicate_rows"))


def type_change_losses(df: DataFrame, changes: dict[str, str]) -> DataFrame:
    """Per column: values that fail the new type and values that come back changed.

    ``changes`` maps a column to its new type (``varchar(n)`` limits length).
    """
    entries = []
    for column, type_ in changes.items():
        value = F.col(column)
        if type_.startswith("varchar("):
            limit = int(type_[8:-1])
            # trailing blanks are cut off without an error
            fails = F.length(F.rtrim(value)) > limit
            lossy = ~fails & (F.length(value) > limit)
        else:
            new = F.expr(f"try_cast(`{column}` AS {type_})")
            fails = value.isNotNull() & new.isNull()
            lossy = new.isNotNull() & (new.cast(df.schema[column].dataType) != value)
        entries.append(F.struct(
            F.lit(column).alias("column"), F.lit(type_).alias("new_type"),
            F.count_if(F.coalesce(fails, F.lit(False))).alias("failing"),
            F.count_if(F.coalesce(lossy, F.lit(False))).alias("lossy")))
    return df.agg(F.array(*entries).alias("c")).select(F.inline("c"))


def is_empty(df: DataFrame) -> DataFrame:
    """ADD COLUMN NOT NULL without a default works on an empty table only."""
    return df.limit(1).agg((F.count("*") == 0).alias("is_empty"))


# --- backfills ---------------------------------------------------------------------
def backfill_volume(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows a backfill touches and their share of the table (per mille)."""
    hit = F.coalesce(predicate, F.lit(False))
    out = df.agg(F.count("*").alias("rows"), F.count_if(hit).alias("matched"))
    return out.withColumn("per_mille", F.when(
        F.col("rows") > 0, int_div(F.col("matched") * 1000, F.col("rows"))))


def window_volume(df: DataFrame, key: str, step: int, predicate: Column) -> DataFrame:
    """Matched rows of each key window ``[n * step, (n + 1) * step)``."""
    lo = F.floor(F.col(key) / step) * step
    return (df.filter(F.coalesce(predicate, F.lit(False)))
            .groupBy(lo.cast("bigint").alias("lo")).agg(F.count("*").alias("matched"))
            .withColumn("hi", F.col("lo") + step))


def key_windows(df: DataFrame, key: str, rows_per_window: int) -> DataFrame:
    """Half-open key ranges that cover the table with about equal row counts.

    Keys are counted first and dealt into ranges that Spark takes from the
    data, however sparse they are; range totals give every range its rank
    offset, so ranks are exact and no task sorts the whole key. Keys must be
    whole numbers: for others there is no next key to end a window at.
    """
    if df.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{key} is no whole number")
    counts = cut_lineage(
        df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k"))
        .agg(F.count("*").alias("m")).repartitionByRange("k")
        .withColumn("part", F.spark_partition_id()))
    ranked = prefix_scan(counts.withColumn("all", F.lit(1)), ["all"], ["k"], F.col("part"),
                         {"before": ("sum", F.col("m"))})
    window = int_div(F.coalesce("before", F.lit(0).cast("bigint")), rows_per_window)
    out = ranked.groupBy(window.alias("window_no")).agg(
        F.min("k").alias("lo"), F.max("k").alias("last"), F.sum("m").alias("rows"))
    return out.select("window_no", "lo", (F.col("last") + 1).alias("hi"), "rows")


def relation_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, stored bytes, null share and distinct values of each column in one pass."""
    entries = F.array(*[F.struct(
        F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"),
        F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0)).alias("bytes"),
        F.approx_count_distinct(F.col(c), 0.01).alias("distinct_estimate")) for c in columns])
    return df.agg(F.count("*").alias("rows"), entries.alias("c")).select(
        "rows", F.inline("c"))


def update_preview(target: DataFrame, source: DataFrame, on: dict[str, str], key: str,
                   old: str, new: str) -> DataFrame:
    """Before and after values of an UPDATE .. FROM, and how many rows match each.

    The server picks any of several matching source rows; those targets show
    ``matches`` above one and the least of the candidate values.
    """
    candidates = source.select(*[F.col(s).alias(t) for t, s in on.items()],
                               F.col(new).alias("new_value"))
    folded = candidates.groupBy(*on).agg(F.count("*").alias("matches"),
                                         F.min("new_value").alias("new_value"))
    return target.join(broadcast_if_small(folded), list(on)).select(
        key, F.col(old).alias("old_value"), "new_value", "matches")


# --- structure -----------------------------------------------------------------------
def drop_impact(edges: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """Relations reached from the roots over referencing foreign keys, with the distance.

    ``edges(keys, child, parent)``, ``roots(keys, relation)``. Walks breadth
    first; each step is written out, so the plan stays one step long.
    """
    links = edges.filter(F.col("child") != F.col("parent")).select(
        *keys, "child", "parent").distinct()
    reached = cut_lineage(roots.select(*keys, F.col("relation").alias("root"), "relation",
                                       F.lit(0).alias("distance")))
    front = reached
    distance = 0
    while True:
        distance += 1
        step = front.select(*keys, "root", F.col("relation").alias("parent")).join(
            broadcast_if_small(links), [*keys, "parent"]).select(
            *keys, "root", F.col("child").alias("relation")).distinct()
        front = cut_lineage(step.join(reached, [*keys, "root", "relation"], "left_anti")
                            .withColumn("distance", F.lit(distance)))
        if front.isEmpty():
            return reached.filter("distance > 0")
        reached = reached.unionByName(front)


def overlapping_rows(df: DataFrame, keys: list[str], lo: str, hi: str, row_id: str,
                     chunk: Column) -> DataFrame:
    """Rows an exclusion constraint would reject, each with one earlier conflict.

    Rows of a key are scanned by start; a row conflicts when an earlier one of
    the same key ends after it starts. The output has one row per rejected row,
    not one per pair. ``chunk`` is a coarse rising function of ``lo``.
    """
    ranges = df.filter(F.col(lo) < F.col(hi))
    latest = F.struct(F.col(hi).alias("hi"), (-F.col(row_id)).alias("neg_id"))
    scanned = prefix_scan(ranges, keys, [lo, row_id], chunk, {"latest": ("max", latest)})
    return scanned.filter(F.col("latest.hi") > F.col(lo)).select(
        *df.columns, (-F.col("latest.neg_id")).alias("conflicts_with"))


def outside_bounds(df: DataFrame, key: str, lo: object, hi: object) -> DataFrame:
    """Rows an attached partition with bounds ``[lo, hi)`` must not hold."""
    inside = (F.col(key) >= F.lit(lo)) & (F.col(key) < F.lit(hi))
    return df.filter(~F.coalesce(inside, F.lit(False)))


def attach_check(partition: DataFrame, default: DataFrame, key: str, lo: object,
                 hi: object) -> DataFrame:
    """Rows outside the new bounds, and default-partition rows that belong inside."""
    bad = outside_bounds(partition, key, lo, hi).agg(F.count("*").alias("outside"))
    inside = (F.col(key) >= F.lit(lo)) & (F.col(key) < F.lit(hi))
    moving = default.filter(inside).agg(F.count("*").alias("in_default"))
    one = F.lit(1).alias("one")
    return bad.select(one, "outside").join(F.broadcast(moving.select(one, "in_default")), "one"
                                           ).drop("one")
