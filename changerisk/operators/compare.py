"""Two runs of the same corpus side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changerisk.functions import tiers
from changerisk.operators.measure import coverage_status
from changerisk.session import cut_lineage


def key_overlap(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys only the old run has, only the new one, and both."""
    tagged = (old.select(*keys).withColumn("side", F.lit(1))
              .unionByName(new.select(*keys).withColumn("side", F.lit(2))))
    sides = tagged.groupBy(*keys).agg(F.bit_or("side").alias("sides"))
    return sides.agg(F.count_if(F.col("sides") == 1).alias("only_old"),
                     F.count_if(F.col("sides") == 2).alias("only_new"),
                     F.count_if(F.col("sides") == 3).alias("shared"))


def paired(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Shared keys with the tier of either run."""
    return old.select(*keys, "kind", F.col("tier").alias("old_tier")).join(
        new.select(*keys, F.col("tier").alias("new_tier")), keys)


def movement_matrix(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("old_tier", "new_tier").agg(F.count("*").alias("n"))


def movement_kinds(pairs: DataFrame, k: int = 8) -> DataFrame:
    """The most frequent kinds behind each move."""
    counts = (pairs.filter(F.col("old_tier") != F.col("new_tier"))
              .groupBy("old_tier", "new_tier", "kind").agg(F.count("*").alias("n")))
    order = W.partitionBy("old_tier", "new_tier").orderBy(F.desc("n"), "kind")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def safety_checks(pairs: DataFrame) -> DataFrame:
    """Moves that matter: unsafe into a safe tier must never happen."""
    old, new = F.col("old_tier"), F.col("new_tier")
    return pairs.agg(
        F.count_if(old == "unsafe").alias("old_unsafe"),
        F.count_if(new == "unsafe").alias("new_unsafe"),
        F.count_if((old == "unsafe") & tiers.is_safe(new)).alias("violations"),
        F.count_if((old == "unsafe") & (new != "unsafe")).alias("softened"),
        F.count_if((old != "unsafe") & (new == "unsafe")).alias("hardened"))


def moves(pairs: DataFrame) -> DataFrame:
    """The single statements that left or entered unsafe."""
    old, new = F.col("old_tier"), F.col("new_tier")
    return pairs.filter((old == "unsafe") != (new == "unsafe")).withColumn(
        "move", F.when(old == "unsafe", F.when(tiers.is_safe(new), "violation")
                       .otherwise("softened")).otherwise("hardened"))


def coverage_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage status of each case before and after, where it changed."""
    def side(run: DataFrame, name: str) -> DataFrame:
        return run.select(*keys, coverage_status(
            F.col("low_ms"), F.col("high_ms"), F.col("measured_ms"), F.col("error")).alias(name))

    joined = side(old, "was").join(side(new, "now"), keys, "full_outer")
    return joined.filter(~F.col("was").eqNullSafe(F.col("now")))


def moves_into(pairs: DataFrame, tier: str, kinds: list[str]) -> DataFrame:
    """Statements of some kinds that moved into a tier."""
    return pairs.filter((F.col("new_tier") == tier) & (F.col("old_tier") != tier)
                        & F.col("kind").isin(*kinds))


def document_changes(left: DataFrame, right: DataFrame, keys: list[str], column: str,
                     volatile: list[str] | None = None) -> DataFrame:
    """Differences between two sets of JSON documents: path, change, old, new.

    ``added`` and ``removed`` name the outermost missing key, ``length`` a list
    whose size changed (its entries are then not compared), ``changed`` any
    other value. Values under ``volatile`` keys are not compared. Documents are
    opened level by level and only the parts that still differ go on, so the
    number of steps is the depth of the deepest difference.
    """
    pairs = left.select(*keys, F.col(column).alias("old")).join(
        right.select(*keys, F.col(column).alias("new")), keys, "full_outer")
    level = pairs.select(*keys, F.lit("").alias("path"), F.to_json(F.parse_json("old")).alias(
        "old"), F.to_json(F.parse_json("new")).alias("new"))
    found = None
    while True:
        level = cut_lineage(_classify_pair(level))
        here = level.filter(F.col("change").isNotNull() & (F.col("change") != "descend"))
        found = here if found is None else found.unionByName(here)
        deeper = level.filter(F.col("change") == "descend")
        if deeper.isEmpty():
            return found
        level = _open_pair(deeper, keys, volatile or [])


def _classify_pair(pairs: DataFrame) -> DataFrame:
    old, new = F.parse_json("old"), F.parse_json("new")
    objects = F.col("old").startswith("{") & F.col("new").startswith("{")
    lists = F.col("old").startswith("[") & F.col("new").startswith("[")
    same_size = F.size(F.when(lists, old).cast("array<variant>")) == F.size(
        F.when(lists, new).cast("array<variant>"))
    return pairs.withColumn("change", (
        F.when(F.col("old").eqNullSafe(F.col("new")), F.lit(None).cast("string"))
        .when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
        .when(objects, "descend").when(lists & same_size, "descend").when(lists, "length")
        .otherwise("changed")))


def _open_pair(pairs: DataFrame, keys: list[str], volatile: list[str]) -> DataFrame:
    """One row per key or position of a pair of containers."""
    def entries(text: str) -> Column:
        value = F.parse_json(text)
        is_list = F.col(text).startswith("[")
        listed = F.transform(F.when(is_list, value).cast("array<variant>"), lambda v, i: F.struct(
            F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("key"),
            F.to_json(v).alias("value")))
        named = F.transform(F.map_entries(F.when(~is_list, value).cast("map<string,variant>")),
                            lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("key"),
                                               F.to_json(e["value"]).alias("value")))
        return F.map_from_entries(F.coalesce(listed, named))

    opened = pairs.select(*keys, "path", entries("old").alias("a"), entries("new").alias("b"))
    rows = opened.select(*keys, "path", "a", "b", F.explode(F.array_union(
        F.map_keys("a"), F.map_keys("b"))).alias("key"))
    hidden = F.substr("key", F.lit(2)).isin(*volatile) if volatile else F.lit(False)
    both = F.map_contains_key("a", F.col("key")) & F.map_contains_key("b", F.col("key"))
    return rows.filter(~(hidden & both)).select(
        *keys, F.concat("path", "key").alias("path"),
        F.try_element_at("a", F.col("key")).alias("old"),
        F.try_element_at("b", F.col("key")).alias("new"))
