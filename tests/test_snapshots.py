"""Snapshots as one row per fact, written, read and folded."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from changerisk import Snapshot, assess, tag_scripts
from changerisk.schemas import FUNCTIONS, RELATIONS, SERVERS
from changerisk.sources import snapshots
from changerisk.workload.verdicts import snapshot

NOW = dt.datetime(2024, 3, 1)


def known(value):
    return (True, value, None)


@pytest.fixture(scope="module")
def small(spark):
    index = ("ix", True, known(99), "btree", False, False, True, ["id"])
    gone = (False, None, "relation does not exist")
    relations = spark.createDataFrame(
        [(d, name, (known(True), known(rows), known(3), known(NOW), known(None), known(8192),
                    known([index]), known([]), known([]))) for d in (1, 2)
         for name, rows in (("t", 5_000_000 * d), ('app."Odd.T"', 7))]
        + [(1, "absent", (known(False), *[gone] * 8)), (3, "unread", None)], RELATIONS)
    servers = spark.createDataFrame([(1, 16, known(NOW), known(215)), (2, 17, known(NOW), gone)],
                                    SERVERS)
    functions = spark.createDataFrame([(1, "f", known("v")), (1, "g", gone)], FUNCTIONS)
    return Snapshot(servers, relations, functions=functions)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_every_fact_comes_back(spark, small, tmp_path):
    snapshots.write_snapshot(small, f"{tmp_path}/s")
    back = snapshots.read_snapshot(spark, f"{tmp_path}/s")
    assert back.relations.schema.simpleString() == small.relations.schema.simpleString()
    # An object without any fact has no row.
    assert rows(back.relations) == rows(small.relations.where("facts IS NOT NULL"))
    assert rows(back.servers) == rows(small.servers)
    assert rows(back.functions) == rows(small.functions)
    assert back.types.collect() == back.waiters.collect() == []


def test_the_corpus_snapshot_comes_back(spark, tmp_path):
    given = snapshot(spark, SF_DIR)
    snapshots.write_snapshot(given, f"{tmp_path}/s")
    back = snapshots.read_snapshot(spark, f"{tmp_path}/s")
    for scope in ("servers", "relations", "types", "type_changes", "waiters"):
        want, got = getattr(given, scope), getattr(back, scope)
        names = list(dict.fromkeys(snapshots.SCOPES[scope].schema().names))
        assert rows(got) == rows(want.select(*names).distinct()), scope


def test_assessment_of_a_read_snapshot(spark, small, tmp_path):
    source = ("ALTER TABLE t ADD CHECK (a > 0); UPDATE t SET a = 1; "
              "ALTER TABLE app.\"Odd.T\" ADD CHECK (a > 0); DROP TABLE absent")
    scripts = spark.createDataFrame([("1", source), ("2", source)], "file_id string, source string")
    statements = tag_scripts(scripts).withColumn("db_id", F.col("file_id").cast("bigint"))
    snapshots.write_snapshot(small, f"{tmp_path}/s")
    back = snapshots.read_snapshot(spark, f"{tmp_path}/s", ("servers", "relations", "functions"))
    a, b = (rows(assess(statements, s).statements.select("file_id", "idx", "verdict"))
            for s in (small, back))
    assert a == b and len(a) == 8
    assert len({r[2]["tier"] for r in a}) > 1


def test_other_formats_repeats_and_unknown_facts(spark, small):
    long = snapshots.snapshot_rows(small)
    old = long.withColumn("snapshot_format", F.lit(4)).withColumn("db_id", F.lit(9).cast("bigint"))
    odd = long.withColumn("fact", F.lit("mood"))
    mixed = long.unionByName(long).unionByName(old).unionByName(odd)
    assert rows(snapshots.folded(mixed, "relations")) == rows(snapshots.folded(long, "relations"))
    plan = snapshots.folded(long, "relations")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
