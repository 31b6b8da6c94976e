"""Files on disk, globs, connection strings and streams with late data."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from changerisk.functions import text
from changerisk.sources import scripts
from changerisk.streaming import jobs, locks


def test_files_are_read_whole_or_rejected(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "bom.sql").write_bytes(b"\xef\xbb\xbfSELECT 1;")
    (tmp_path / "plain.sql").write_text("SELECT 2;", encoding="utf8")
    (tmp_path / "nul.sql").write_bytes(b"SELECT 1;\nSELECT \x00;")
    (tmp_path / "latin.sql").write_bytes(b"SELECT '\xe9';")
    (tmp_path / "notes.md").write_text("no", encoding="utf8")
    decoded = scripts.decode_scripts(scripts.read_files(spark, str(tmp_path)))
    good = {r["source"] for r in scripts.accepted(decoded).collect()}
    bad = {r["path"].rsplit("/", 1)[-1]: (r["error"], r["error_line"])
           for r in scripts.rejected(decoded).collect()}
    assert good == {"SELECT 1;", "SELECT 2;"}
    assert bad == {"nul.sql": ("contains a NUL byte", 2), "latin.sql": ("not valid UTF-8", None)}


def test_globs_keep_to_their_segment():
    def hits(glob, path):
        return re.match(text.glob_to_regex(glob), path) is not None

    assert hits("migrations/*.sql", "migrations/1.sql")
    assert not hits("migrations/*.sql", "migrations/2024/1.sql")
    assert hits("a/**/b.sql", "a/b.sql") and hits("a/**/b.sql", "a/x/y/b.sql")
    assert hits("v?.sql", "v1.sql") and not hits("v?.sql", "v10.sql")
    assert hits("[!a]*.sql", "b.sql") and not hits("[!a]*.sql", "a.sql")
    assert hits("x+y.sql", "x+y.sql") and not hits("x+y.sql", "xxy.sql")


def test_connection_strings(spark):
    rows = spark.createDataFrame([
        ("postgresql://u:p%40ss@h1:5432,[::1]:5433/db?sslmode=require",),
        ("host=h password='a b' dbname=x",), ("",)], "c string")
    got = [r["p"] for r in rows.select(text.parse_conninfo(F.col("c")).alias("p")).collect()]
    assert got[0]["user"] == "u" and got[0]["password"] == "p@ss"
    assert got[0]["host"] == "h1" and got[0]["port"] == "5432" and got[0]["dbname"] == "db"
    assert got[0]["sslmode"] == "require"
    assert got[1] == {"host": "h", "password": "a b", "dbname": "x"}
    assert got[2] == {}


def test_late_samples_do_not_change_a_final_window(spark, tmp_path):
    schema = "ts timestamp, table string, op string, ms bigint, done boolean"

    def feed(name, rows):
        spark.createDataFrame(rows, "ts string, table string, op string, ms bigint, done boolean"
                              ).select(F.col("ts").cast("timestamp"), "table", "op", "ms", "done"
                                       ).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    at = "2024-01-01 00:{:02d}:00"
    folder = str(tmp_path / "out")

    def drain():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        return jobs.drain(locks.stall_monitor(stream.withWatermark("ts", "1 minute")), folder)

    feed("1", [(at.format(1), "t", "read", 5, True), (at.format(10), "t", "read", 7, True)])
    first = drain()
    assert [(r["read_stall_ms"]) for r in first.collect()] == [5]
    # a sample of the finished window arrives late, then time moves on
    feed("2", [(at.format(1), "t", "read", 999, True), (at.format(20), "t", "write", 9, False)])
    rows = drain().orderBy("start").collect()
    assert [(r["read_stall_ms"], r["write_stall_ms"]) for r in rows] == [(5, None), (7, None)]
