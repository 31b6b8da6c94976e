"""Lock and latency samples as streams.

Every function takes a batch or a streaming frame, so a stored feed and a live
one give the same rows. Streaming callers set the watermark; a window is final
once the watermark has passed its end, and later samples are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changerisk.functions.tiers import mode_level


def lock_rollup(samples: DataFrame, window: str = "1 minute") -> DataFrame:
    """Modes seen per session and window, with counts and the first grant.

    ``samples(ts, session, relation, mode, granted, index_live, is_target)``.
    Samples of an index no longer live lock nothing others can see.
    """
    live = samples.filter(F.coalesce("index_live", F.lit(True)))
    granted = F.col("granted")
    return live.groupBy(F.window("ts", window).alias("w"), "session", "mode").agg(
        F.count_if(granted).alias("granted_samples"),
        F.count_if(~granted).alias("waiting_samples"),
        F.min(F.when(granted & F.col("is_target"), F.col("ts"))).alias("first_granted"),
        F.max(F.when(~granted, F.col("ts"))).alias("last_waiting")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "session", "mode",
        mode_level(F.col("mode")).alias("level"), "granted_samples", "waiting_samples",
        "first_granted", "last_waiting")


def lock_waits(rollup: DataFrame) -> DataFrame:
    """Wait per session and window: from its start to the first grant on a target."""
    return rollup.groupBy("start", "session").agg(
        F.min("first_granted").alias("first_granted"), F.max("level").alias("level"),
        F.count("*").alias("modes")).withColumn(
        "wait_ms", F.timestamp_diff("MILLISECOND", F.col("start"), F.col("first_granted")))


def stall_monitor(latencies: DataFrame, window: str = "1 minute") -> DataFrame:
    """Worst read and write latency per table and window.

    ``latencies(ts, table, op, ms, done)``. A query still in flight reports
    itself with heartbeats (``done`` false, ``ms`` so far).
    """
    read = F.col("op") == "read"
    return latencies.groupBy(F.window("ts", window).alias("w"), "table").agg(
        F.max(F.when(read, F.col("ms"))).alias("read_stall_ms"),
        F.max(F.when(~read, F.col("ms"))).alias("write_stall_ms"),
        F.count_if(~F.col("done")).alias("heartbeats")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "table", "read_stall_ms",
        "write_stall_ms", "heartbeats")


def idle_transactions(activity: DataFrame, gap: str = "30 seconds",
                      threshold_s: int = 60) -> DataFrame:
    """Backends seen idle in a transaction for longer than the threshold.

    Sightings closer than ``gap`` form one session window per backend.
    """
    idle = activity.filter(F.col("state").startswith("idle in transaction"))
    seen = idle.groupBy(F.session_window("ts", gap).alias("w"), "db_id", "pid").agg(
        F.min("ts").alias("since"), F.max("ts").alias("until"),
        F.count("*").alias("sightings"))
    return seen.withColumn("idle_s", F.timestamp_diff("SECOND", F.col("since"), F.col("until"))
                           ).filter(F.col("idle_s") >= threshold_s).select(
        "db_id", "pid", "since", "until", "sightings", "idle_s")
