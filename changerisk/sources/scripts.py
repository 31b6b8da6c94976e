"""Script corpora, manifests, changed-path lists, rule files and run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changerisk.functions.text import normalize_path

_BOM = "﻿"
RULES = """
rule_ord int, kind string, is_action boolean, lo int, hi int,
when map<string,array<string>>, level int, blocks_reads boolean, blocks_writes boolean,
rewrite boolean, duration string, available boolean, calibrated boolean, live boolean,
txn string, write_scope string,
affected array<struct<role:string,level:int,optional:boolean,resolvable:boolean>>, undo string
"""


def read_files(spark: SparkSession, path: str, glob: str = "*.sql") -> DataFrame:
    """Whole files as ``path, content``, read in parallel."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true").load(path).select("path", "content"))


def decode_scripts(files: DataFrame) -> DataFrame:
    """Add ``source`` and, for files that cannot be read whole, ``error`` and its line.

    A NUL byte or invalid UTF-8 makes the file an error, never a partial
    script. A leading byte order mark is dropped.
    """
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    stripped = F.when(text.startswith(_BOM), F.substr(text, F.lit(2))).otherwise(text)
    nul = F.when(valid, F.instr(text, "\u0000")).otherwise(0)
    before = F.substr(text, F.lit(1), nul - 1)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    error = F.when(~valid, "not valid UTF-8").when(nul > 0, "contains a NUL byte")
    return files.select(
        "*", F.when(error.isNull(), stripped).alias("source"), error.alias("error"),
        F.when(valid & (nul > 0), line).alias("error_line"))


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("error").isNull())


def rejected(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("error").isNotNull()).select("path", "error", "error_line")


def check_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Status of each manifest entry ``(file, sha256, bytes)``: ok, missing or changed."""
    actual = files.select(
        F.substring_index("path", "/", -1).alias("file"),
        F.sha2("content", 256).alias("actual_sha256"),
        F.octet_length("content").alias("actual_bytes"))
    joined = manifest.join(actual, "file", "left")
    return joined.withColumn("status", F.when(F.col("actual_sha256").isNull(), "missing").when(
        (F.col("actual_sha256") == F.col("sha256")) & (F.col("actual_bytes") == F.col("bytes")),
        "ok").otherwise("changed"))


def read_changed_paths(spark: SparkSession, path: str) -> DataFrame:
    """A list of paths, one per line; blank lines are dropped."""
    return changed_paths(spark.read.text(path).select(F.col("value").alias("path")))


def changed_paths(lines: DataFrame) -> DataFrame:
    trimmed = F.regexp_replace("path", r"^\s+|\s+$", "")
    return lines.select(trimmed.alias("path")).filter(F.col("path") != "").select(
        normalize_path(F.col("path")).alias("path"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule table stored as JSON or Parquet in the schema of the built-in one."""
    reader = spark.read.schema(RULES)
    return reader.parquet(path) if path.rstrip("/").endswith(".parquet") else reader.json(path)


def write_verdicts(statements: DataFrame, path: str, run_id: str) -> None:
    """Append a run's verdict rows under its own partition."""
    (statements.select("file_id", "idx", F.col("statement_kind").alias("kind"),
                       F.col("verdict.tier").alias("tier"), F.col("verdict.band").alias("band"),
                       F.col("verdict.method").alias("method"), F.lit(run_id).alias("run_id"))
     .write.mode("append").partitionBy("run_id").parquet(path))


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Verdict rows of all runs; a filter on ``run_id`` prunes to its files."""
    return spark.read.schema("file_id string, idx bigint, kind string, tier string, "
                             "band string, method string, run_id string").parquet(path)
