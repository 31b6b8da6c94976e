"""Lock and latency samples of the event log as streams.

Each query reads the whole event file as a stream in append mode, so it shows
the rows the watermark has made final: windows that end at or before the
newest sample minus the delay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changerisk.streaming import jobs, locks
from changerisk.workload import adapters
from changerisk.workload.adapters import pick, table
from changerisk.workload.registry import query
from changerisk.workload.texts import script_source

EVENTS = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
          "props string")
DELAY = "10 minutes"


def table_stream(spark, sf, name: str, schema: str) -> DataFrame:
    """A given table as a stream, be it one file or a folder of part files.

    As a pattern, so that the source takes no folder for the base of partitions.
    """
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}[.]parquet")


def event_stream(spark, sf) -> DataFrame:
    raw = table_stream(spark, sf, "events", EVENTS)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def samples(events: DataFrame) -> DataFrame:
    i = F.col("event_id")
    return events.select(
        "ts", F.col("user_id").alias("session"),
        F.concat(F.lit("t"), (i % 7).cast("string")).alias("relation"),
        pick(adapters.WAIT_MODES, i % 8).alias("mode"), (F.col("value") > 50).alias("granted"),
        (i % 13 != 0).alias("index_live"), (i % 7 < 3).alias("is_target"))


_FINAL = "WHERE w_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query("lock_sample_stream", f"""
WITH s AS (SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS w, ts, user_id AS session, event_id % 8 AS m,
             value > 50 AS granted, event_id % 7 < 3 AS is_target FROM events WHERE event_id % 13 <> 0),
a AS (SELECT w, w + INTERVAL 60 MINUTE AS w_end, session, m, count(*) FILTER (WHERE granted) AS g,
        count(*) FILTER (WHERE NOT granted) AS n,
        min(ts) FILTER (WHERE granted AND is_target) AS first_ FROM s GROUP BY 1, 2, 3, 4)
SELECT epoch_us(w) AS start_us, session, CAST(m + 1 AS INT) AS level, g AS granted_samples, n AS waiting_samples,
       coalesce(epoch_us(first_), -1) AS first_granted_us FROM a {_FINAL}""")
def lock_sample_stream(spark, sf):
    stream = samples(event_stream(spark, sf)).withWatermark("ts", DELAY)
    done = jobs.drain(locks.lock_rollup(stream, "60 minutes"))
    return done.select(
        F.unix_micros("start").alias("start_us"), "session", "level", "granted_samples",
        "waiting_samples",
        F.coalesce(F.unix_micros("first_granted"), F.lit(-1)).alias("first_granted_us"))


@query("lock_sample_waits", """
WITH s AS (SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS w, ts, user_id AS session, event_id % 8 AS m,
             value > 50 AND event_id % 7 < 3 AS hit FROM events WHERE event_id % 13 <> 0)
SELECT epoch_us(w) AS start_us, session, CAST(max(m) + 1 AS INT) AS level, count(DISTINCT m) AS modes,
  coalesce((epoch_us(min(ts) FILTER (WHERE hit)) - epoch_us(w)) // 1000, -1) AS wait_ms
FROM s GROUP BY w, session""")
def lock_sample_waits(spark, sf):
    """The same rollup over the stored feed, with the wait per session and window."""
    batch = samples(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    waits = locks.lock_waits(locks.lock_rollup(batch, "60 minutes"))
    return waits.select(F.unix_micros("start").alias("start_us"), "session", "level", "modes",
                        F.coalesce("wait_ms", F.lit(-1)).alias("wait_ms"))


@query("stall_stream", f"""
WITH a AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS w, event_id % 7 AS t,
    max(CAST(floor(value) AS BIGINT)) FILTER (WHERE event_id % 2 = 0) AS r,
    max(CAST(floor(value) AS BIGINT)) FILTER (WHERE event_id % 2 = 1) AS wr,
    count(*) FILTER (WHERE event_id % 5 = 0) AS beats FROM events GROUP BY 1, 2),
b AS (SELECT *, w + INTERVAL 30 MINUTE AS w_end FROM a)
SELECT epoch_us(w) AS start_us, 't' || CAST(t AS VARCHAR) AS table_name, coalesce(r, -1) AS read_ms,
       coalesce(wr, -1) AS write_ms, beats AS heartbeats FROM b {_FINAL}""")
def stall_stream(spark, sf):
    i = F.col("event_id")
    feed = event_stream(spark, sf).select(
        "ts", F.concat(F.lit("t"), (i % 7).cast("string")).alias("table"),
        F.when(i % 2 == 0, "read").otherwise("write").alias("op"),
        F.floor("value").cast("bigint").alias("ms"), (i % 5 != 0).alias("done"))
    done = jobs.drain(locks.stall_monitor(feed.withWatermark("ts", DELAY), "30 minutes"))
    return done.select(
        F.unix_micros("start").alias("start_us"), F.col("table").alias("table_name"),
        F.coalesce("read_stall_ms", F.lit(-1)).alias("read_ms"),
        F.coalesce("write_stall_ms", F.lit(-1)).alias("write_ms"), "heartbeats")


_GAP = 7200


@query("idle_transaction_stream", f"""
WITH s AS (SELECT user_id % 5 AS db_id, user_id AS pid, ts FROM events WHERE event_id % 3 <> 0),
g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL {_GAP} SECOND
             THEN 1 ELSE 0 END AS starts FROM s WINDOW w AS (PARTITION BY db_id, pid ORDER BY ts)),
n AS (SELECT *, sum(starts) OVER (PARTITION BY db_id, pid ORDER BY ts) AS no FROM g),
a AS (SELECT db_id, pid, min(ts) AS since, max(ts) AS until, count(*) AS sightings FROM n
      GROUP BY db_id, pid, no)
SELECT db_id, pid, epoch_us(since) AS since_us, sightings,
       (epoch_us(until) - epoch_us(since)) // 1000000 AS idle_s
FROM a WHERE (epoch_us(until) - epoch_us(since)) // 1000000 >= 60
  AND until + INTERVAL {_GAP} SECOND <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def idle_transaction_stream(spark, sf):
    i = F.col("event_id")
    feed = event_stream(spark, sf).select(
        "ts", (F.col("user_id") % 5).alias("db_id"), F.col("user_id").alias("pid"),
        F.when(i % 3 == 0, "active").when(i % 3 == 1, "idle in transaction").otherwise(
            "idle in transaction (aborted)").alias("state"))
    done = jobs.drain(locks.idle_transactions(feed.withWatermark("ts", DELAY),
                                              f"{_GAP} seconds", 60))
    return done.select("db_id", "pid", F.unix_micros("since").alias("since_us"), "sightings",
                       "idle_s")


# Every script is one transaction. What it does to its own new table is safe, though written rows
# are not given back; an index cannot be built concurrently inside; from the ALTER on a blocking
# lock is held, so later work that takes time needs timing; the rest is unknown without facts.
@query("continuous_assessment", """
SELECT v.kind, v.tier, n.statements FROM (VALUES
  ('begin', 'safe'), ('create_table', 'safe'), ('insert', 'safe'),
  ('create_index_concurrently', 'unsafe'), ('alter_table', 'safe'),
  ('update_batched', 'safe_irreversible'), ('delete_without_where', 'unknown'),
  ('select', 'needs_timing'), ('create_matview', 'needs_timing'),
  ('alter_enum_add_value', 'safe_irreversible'), ('other', 'unknown'),
  ('drop_table', 'needs_timing'), ('commit', 'safe')) v(kind, tier),
  (SELECT count(*) AS statements FROM documents) n""")
def continuous_assessment(spark, sf):
    """Script files from documents assessed as they arrive."""
    docs = table_stream(spark, sf, "documents", "doc_id bigint, text string, lang string, "
                        "source string, n_chars bigint")
    scripts = docs.select(F.col("doc_id").cast("string").alias("file_id"),
                          script_source().alias("source"))
    done = jobs.assess_stream(scripts, jobs.stream_folder(spark), pg_version=17)
    return done.groupBy("kind", "tier").agg(F.count("*").alias("statements"))
