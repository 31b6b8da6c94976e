"""Dimension tables as DataFrames.

Every dimension here is a fixed table of at most a few thousand rows, so it is
always safe to broadcast. User-supplied dimensions go through
:func:`changerisk.session.broadcast_if_small` instead.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changerisk.seeds import tables

_RULE_TYPE = pa.schema([
    ("rule_ord", pa.int32()), ("kind", pa.string()), ("is_action", pa.bool_()),
    ("lo", pa.int32()), ("hi", pa.int32()),
    ("when", pa.map_(pa.string(), pa.list_(pa.string()))),
    ("level", pa.int32()), ("blocks_reads", pa.bool_()), ("blocks_writes", pa.bool_()),
    ("rewrite", pa.bool_()), ("duration", pa.string()), ("available", pa.bool_()),
    ("calibrated", pa.bool_()), ("live", pa.bool_()), ("txn", pa.string()),
    ("write_scope", pa.string()),
    ("affected", pa.list_(pa.struct([("role", pa.string()), ("level", pa.int32()),
                                     ("optional", pa.bool_()), ("resolvable", pa.bool_())]))),
    ("undo", pa.string()),
])


def _frame(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def rules(spark: SparkSession) -> DataFrame:
    """The built-in rule dimension, one row per kind, version range and variant."""
    rows = [{**r, "when": list(r["when"].items())} for r in tables.rule_rows()]
    return _frame(spark, rows, _RULE_TYPE)


def conflicts(spark: SparkSession) -> DataFrame:
    code = {c: mode for mode, c, _, _ in tables.LOCK_MODES}
    rows = [{"mode": code[a], "other": code[b]} for a, b in tables.conflict_pairs()]
    return _frame(spark, rows, pa.schema([("mode", pa.string()), ("other", pa.string())]))


def breakpoints(spark: SparkSession) -> DataFrame:
    rows = [{"kind": k, "version": v} for k, v in tables.breakpoints()]
    return _frame(spark, rows, pa.schema([("kind", pa.string()), ("version", pa.int32())]))


def rates(spark: SparkSession) -> DataFrame:
    """Throughput constants with their provenance."""
    schema = pa.schema([("key", pa.string()), ("unit", pa.string()), ("value", pa.int64()),
                        ("calibration", pa.string())]
                       + [(n, pa.int64()) for n in ("runs", "spread", "profiles",
                                                    "cross_spread")])
    return _frame(spark, tables.rate_rows(), schema)


def volatility_functions(spark: SparkSession) -> DataFrame:
    return _frame(spark, tables.volatility_rows(),
                  pa.schema([("name", pa.string()), ("rank", pa.int32())]))


def _literal(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(mapping: dict) -> Column:
    """A constant map column; lookups through it stay inside the projection."""
    return F.expr("map(" + ", ".join(_literal(x) for pair in mapping.items() for x in pair) + ")")


def lookup(mapping: dict, key: Column) -> Column:
    """``mapping[key]``, NULL when the key is absent."""
    return F.try_element_at(literal_map(mapping), key)
