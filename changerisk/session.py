"""Session settings shared by every job: lineage cuts and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``; a folder of our own is
    set only where that is unset and the session runs in one local process.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        current = tempfile.mkdtemp(prefix="changerisk-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared checkpoint folder and read it back.

    Stored as Parquet, so later steps read only the columns they need, know
    the real size, and survive the loss of any executor.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/changerisk-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return int(str(plan.stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only when the size estimate is under ``limit``.

    Beyond it the frame is returned as it is, so Spark plans a shuffled join
    and adaptive execution splits skewed partitions.
    """
    return F.broadcast(df) if estimated_bytes(df) <= limit else df
