"""Snapshots, evaluation results and hardware profiles stored as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changerisk.operators.measure import at_scale
from changerisk.schemas import FACT, RELATION_FACTS

SNAPSHOT_FORMAT = 5
SNAPSHOT = (
    "snapshot_format int, db_id bigint, "
    f"server struct<pg_major:{FACT.format('int')},server_now:{FACT.format('timestamp')}>, "
    f"calibration struct<compute_ms:{FACT.format('bigint')}>, "
    f"relations array<struct<requested:string,facts:{RELATION_FACTS}>>"
)
RESULT_FILE = """
results array<struct<case:string,family:string,adversarial:string,
statements:array<struct<index:bigint,kind:string,outcome:string,
predicted:struct<tier:string,refusal:string,refused_from:string,deciding_kind:string,
deciding_constant_key:string,deciding_high_ms:bigint>,
truth:struct<tier:string,block:string,hold_ms:bigint,boundary_proximity:double>>>>>
"""
PROFILE_FILE = """
profile string, index_bytes map<string,bigint>,
records array<struct<case:string,family:string,table:string,rows:bigint,ms:bigint,
pass_:int,error:string>>, probes array<struct<compute_ms:bigint,scan_ms:bigint>>
"""


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """One document per database; other snapshot formats are left out."""
    return spark.read.schema(SNAPSHOT).json(path).filter(
        F.col("snapshot_format") == SNAPSHOT_FORMAT)


def snapshot_relations(snapshots: DataFrame) -> DataFrame:
    """The relation facts of each database, one row per relation."""
    return snapshots.select("db_id", F.inline("relations")).select(
        "db_id", F.col("requested").alias("relation"), "facts")


def snapshot_servers(snapshots: DataFrame) -> DataFrame:
    return snapshots.select(
        "db_id", F.when(F.col("server.pg_major.available"), F.col("server.pg_major.value")
                        ).alias("pg_version"),
        F.col("server.server_now").alias("server_now"),
        F.col("calibration.compute_ms").alias("probe"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return executed_statements(spark.read.schema(RESULT_FILE).json(path))


def executed_statements(documents: DataFrame) -> DataFrame:
    """Statements that were executed, one row each."""
    cases = documents.select(F.inline("results"))
    rows = cases.select(F.col("case").alias("case_id"), "family", "adversarial",
                        F.inline("statements"))
    return rows.filter(F.col("truth").isNotNull()).select(
        "case_id", "family", "adversarial", F.col("index").alias("idx"), "kind", "outcome",
        F.col("predicted.tier").alias("predicted"), F.col("predicted.refusal").alias("refusal"),
        F.col("predicted.refused_from").alias("refused_from"),
        F.col("predicted.deciding_kind").alias("deciding_kind"),
        F.col("predicted.deciding_constant_key").alias("constant_key"),
        F.col("predicted.deciding_high_ms").alias("high_ms"),
        F.col("truth.tier").alias("truth"), F.col("truth.block").alias("block"),
        F.col("truth.hold_ms").alias("hold_ms"),
        F.col("truth.boundary_proximity").alias("proximity"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE_FILE).option("multiLine", "true").json(path)


def profile_readings(documents: DataFrame) -> DataFrame:
    """Error-free readings at scale of every profile."""
    rows = documents.select("profile", "index_bytes", F.inline("records"))
    return rows.filter(F.col("error").isNull() & F.col("ms").isNotNull()
                       & at_scale(F.col("family"), F.col("rows"))).select(
        "profile", F.col("case").alias("case_id"), "family", "table", "rows", "ms",
        F.col("pass_").alias("pass_no"),
        F.try_element_at("index_bytes", F.col("table")).alias("index_bytes"))


def profile_probes(documents: DataFrame) -> DataFrame:
    return documents.select("profile", F.inline("probes")).filter(
        F.col("compute_ms").isNotNull())
