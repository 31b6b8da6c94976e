"""Running the streams: sinks, checkpoints and continuous assessment."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changerisk.functions.tagging import block_statements, split_statements, tag_statements
from changerisk.operators.verdict import Snapshot
from changerisk.plans.assess import assess
from changerisk.session import checkpoint_dir


def stream_folder(spark: SparkSession) -> str:
    """A new folder for one stream's output and progress, shared by all executors."""
    return f"{checkpoint_dir(spark).rstrip('/')}/changerisk-stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Run a stream over all data available now and return what it wrote.

    Append mode: only rows the watermark has made final are written, each
    exactly once, also after a restart from the same folder.
    """
    spark = stream.sparkSession
    folder = folder or stream_folder(spark)
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", f"{folder}/progress")
             .trigger(availableNow=True).start(f"{folder}/rows"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def tag_scripts(scripts: DataFrame) -> DataFrame:
    """Scripts ``(file_id, source)`` to tagged statements, blocks opened."""
    return block_statements(tag_statements(split_statements(scripts)))


def assess_stream(scripts: DataFrame, folder: str, pg_version: int,
                  snapshot: Callable[[], Snapshot] | None = None) -> DataFrame:
    """Assess script files as they arrive, with the latest snapshot of each moment.

    Every micro-batch holds whole files, so file state needs no stream state.
    A repeated batch overwrites its own output partition. Without a batch the
    result is empty.
    """
    spark = scripts.sparkSession
    schema = "file_id string, idx bigint, kind string, tier string, method string"
    # A table of no rows, to be read where no batch comes.
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/rows/batch=-1")

    def run(batch: DataFrame, batch_id: int) -> None:
        done = assess(tag_scripts(batch), snapshot() if snapshot else None,
                      pg_version=pg_version)
        rows = done.statements.select(
            "file_id", "idx", F.col("statement_kind").alias("kind"),
            F.col("verdict.tier").alias("tier"), F.col("verdict.method").alias("method"))
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    query = (scripts.writeStream.foreachBatch(run)
             .option("checkpointLocation", f"{folder}/progress")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(f"{schema}, batch bigint").parquet(f"{folder}/rows")
