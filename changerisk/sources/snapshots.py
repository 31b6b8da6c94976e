"""Snapshots as long tables: one row per fact of one object of one database.

A database may have any number of relations, types and sessions, so nothing of
a snapshot is a list per database. Each fact is a row ``(snapshot_format, db_id,
scope, object, fact, value)``; ``value`` is a variant, so all kinds of facts
share one table. Objects are folded back to the columns that ``assess`` takes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changerisk import schemas
from changerisk.operators.verdict import Snapshot
from changerisk.sources.records import SNAPSHOT_FORMAT

FACT_ROWS = ("snapshot_format int, db_id bigint, scope string, object array<string>, "
             "fact string, value variant")


@dataclass(frozen=True)
class Scope:
    """How the rows of one snapshot table are keyed; ``nested`` names its struct of facts, if any."""

    ddl: str
    keys: tuple[str, ...]
    nested: str | None = None

    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)

    def fields(self) -> dict[str, tuple[Column, str]]:
        """Facts with the column that holds each and its type."""
        schema = self.schema()
        if self.nested:
            return {f.name: (F.col(f"{self.nested}.{f.name}"), f.dataType.simpleString())
                    for f in schema[self.nested].dataType.fields}
        return {f.name: (F.col(f.name), f.dataType.simpleString()) for f in schema.fields
                if f.name not in ("db_id", *self.keys)}


#: Tables of a snapshot by the name of their attribute.
SCOPES = {
    "servers": Scope(schemas.SERVERS, ()),
    "relations": Scope(schemas.RELATIONS, ("relation",), "facts"),
    "types": Scope(schemas.TYPES, ("type_name",), "type_facts"),
    "type_changes": Scope(schemas.TYPE_CHANGES, ("relation", "column", "new_type"), "change"),
    "functions": Scope(schemas.FUNCTIONS, ("function",)),
    "waiters": Scope(schemas.WAITERS, ("relation", "blocked_pid", "blocked_mode")),
}


def fact_rows(df: DataFrame, scope: str) -> DataFrame:
    """The facts of one snapshot table; a NULL fact has no row, an unavailable one has."""
    kind = SCOPES[scope]
    facts = F.array(*[F.struct(F.lit(name).alias("fact"), F.when(
        column.isNotNull(), F.to_variant_object(F.struct(column.alias("v")))).alias("value"))
        for name, (column, _) in kind.fields().items()])
    keys = F.array(*[F.col(k).cast("string") for k in kind.keys]).cast("array<string>")
    return df.select("db_id", keys.alias("object"), F.explode(facts).alias("f")).where(
        "f.value IS NOT NULL").select(
        F.lit(SNAPSHOT_FORMAT).alias("snapshot_format"), "db_id", F.lit(scope).alias("scope"),
        "object", "f.fact", "f.value")


def snapshot_rows(snapshot: Snapshot) -> DataFrame:
    """All facts of a snapshot in one long table."""
    tables = [fact_rows(getattr(snapshot, scope), scope) for scope in SCOPES
              if getattr(snapshot, scope) is not None]
    out, *rest = tables
    for df in rest:
        out = out.unionByName(df)
    return out


def folded(rows: DataFrame, scope: str) -> DataFrame:
    """One snapshot table of long rows: an object's facts meet in one row.

    Facts of an unknown name are left out, missing ones are NULL. Repeated rows
    of a fact count once; objects without any fact do not come back.
    """
    kind = SCOPES[scope]
    fields = kind.fields()
    wanted = rows.where((F.col("scope") == scope) & (F.col("snapshot_format") == SNAPSHOT_FORMAT)
                        & F.col("fact").isin(*fields))
    grouped = wanted.groupBy("db_id", "object").agg(*[
        F.any_value(F.when(F.col("fact") == name, F.col("value")), ignoreNulls=True).alias(name)
        for name in fields])
    value: Callable[[str, str], Column] = lambda name, type_: F.variant_get(
        name, "$.v", type_).alias(name)
    facts = [value(name, type_) for name, (_, type_) in fields.items()]
    if kind.nested:
        facts = [F.struct(*facts).alias(kind.nested)]
    schema = kind.schema()
    keys = [F.get("object", F.lit(i)).cast(schema[k].dataType).alias(k)
            for i, k in enumerate(kind.keys)]
    return grouped.select("db_id", *keys, *facts).select(*schema.names)


def write_snapshot(snapshot: Snapshot, path: str) -> None:
    """The long table as Parquet, a folder per scope, so that a reader opens what it folds."""
    snapshot_rows(snapshot).write.mode("append").partitionBy("scope").parquet(path)


def read_snapshot(spark: SparkSession, path: str, scopes: tuple[str, ...] = tuple(SCOPES)) -> Snapshot:
    """The snapshot of all databases in a folder; other formats are left out."""
    rows = spark.read.schema(FACT_ROWS).parquet(path)
    return Snapshot(**{s: folded(rows, s) for s in scopes})
