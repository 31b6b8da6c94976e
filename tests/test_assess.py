"""The whole assessment on small scripts: one file per case, assessed together."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from changerisk import assess, tag_scripts
from changerisk.operators.verdict import Snapshot
from changerisk.schemas import RELATIONS
from changerisk.seeds import tables

GROWING = "DELETE FROM t; ALTER TABLE t ADD CONSTRAINT k UNIQUE (a);"
SIZED = ("CREATE INDEX i ON t (a); "
         "ALTER TABLE t ADD COLUMN c uuid DEFAULT gen_random_uuid();")
SCRIPTS = {
    "plain": "CREATE INDEX i ON t (a); UPDATE t SET a = 1;",
    "local": "CREATE TABLE n (a int); CREATE INDEX i ON n (a); ALTER TABLE n ADD CHECK (a > 0);",
    "block": "BEGIN; CREATE INDEX CONCURRENTLY i ON t (a); COMMIT;",
    "drop": "CREATE TABLE n (a int); DROP TABLE n;",
    "guard": "DO $$ BEGIN IF to_regclass('x') IS NOT NULL THEN "
             "CREATE INDEX CONCURRENTLY i ON t (a); END IF; END $$;",
    "held": "BEGIN; ALTER TABLE t ADD COLUMN c int; SELECT count(*) FROM u; COMMIT;",
    "lines": "SELECT 1;\n\nSELECT ';';\n-- x\nSELECT 2",
}
# one database per case: rows of its table t, server version, script
DATABASES = {
    1: (1000, 17, SIZED), 2: (500_000_000, 17, SIZED),
    # 13,000 rows/s: 700,000 rows take 54 s, within 1.5x of the one-minute line
    3: (700_000, 17, "UPDATE t SET a = 1;"),
    4: (10, 14, "MERGE INTO t USING s ON true WHEN MATCHED THEN DELETE;"),
    5: (1_000, 17, GROWING), 6: (100_000, 17, GROWING), 7: (10_000_000, 17, GROWING),
    8: (1_000_000_000, 17, GROWING),
}


def collect(statements):
    rows = statements.orderBy("file_id", "idx").select(
        "file_id", "statement_kind", "line", "verdict").collect()
    out: dict[str, list] = {}
    for row in rows:
        out.setdefault(row["file_id"], []).append(row)
    return out


@pytest.fixture(scope="module")
def offline(spark):
    scripts = spark.createDataFrame(list(SCRIPTS.items()), "file_id string, source string")
    return collect(assess(tag_scripts(scripts), pg_version=17).statements)


@pytest.fixture(scope="module")
def online(spark):
    now = dt.datetime(2024, 3, 1)

    def known(value):
        return (True, value, None)

    scripts = spark.createDataFrame([(str(k), sql) for k, (_, _, sql) in DATABASES.items()],
                                    "file_id string, source string")
    statements = tag_scripts(scripts).withColumn("db_id", F.col("file_id").cast("bigint"))
    servers = spark.createDataFrame(
        [(k, version, known(now), known(215)) for k, (_, version, _) in DATABASES.items()],
        "db_id bigint, pg_version int, "
        "server_now struct<available:boolean,value:timestamp,reason:string>, "
        "probe struct<available:boolean,value:bigint,reason:string>")
    facts = [(k, "t", (known(True), known(rows), known(0), known(now), known(None), known(8192),
                       known([]), known([]), known([]))) for k, (rows, _, _) in DATABASES.items()]
    relations = spark.createDataFrame(facts, RELATIONS)
    return collect(assess(statements, Snapshot(servers, relations)).statements)


def tiers(found, file_id):
    return [row["verdict"]["tier"] for row in found[str(file_id)]]


def test_offline_is_unknown_never_unsafe(offline):
    assert tiers(offline, "plain") == ["unknown", "unknown"]


def test_file_local_work_is_safe(offline):
    assert tiers(offline, "local") == ["safe", "safe", "safe"]


def test_concurrent_index_inside_a_block_fails(offline):
    assert tiers(offline, "block") == ["safe", "unsafe", "safe"]


def test_irreversible_but_local_is_its_own_tier(offline):
    assert tiers(offline, "drop")[1] == "safe_irreversible"


def test_guarded_block_is_capped(offline):
    assert [(r["statement_kind"], r["verdict"]["tier"]) for r in offline["guard"]] == [
        ("do_block", "needs_timing")]


def test_held_locks_prolong_a_safe_statement(offline):
    assert tiers(offline, "held")[2] == "needs_timing"


def test_lines_point_at_the_statement(offline):
    assert [row["line"] for row in offline["lines"]] == [1, 1, 3]


def test_size_decides(online):
    assert tiers(online, 1) == ["safe", "needs_timing"]
    assert tiers(online, 2) == ["unsafe", "unsafe"]


def test_boundary_refuses(online):
    v = online["3"][0]["verdict"]
    assert (v["tier"], v["refusal"], v["refused_from"]) == ("unknown", "boundary", "unsafe")


def test_forms_newer_than_the_server_are_unsafe(online):
    assert tiers(online, 4) == ["unsafe"]


def test_tiers_never_soften_as_tables_grow(online):
    ranks = [[tables.TIER_RANK[t] for t in tiers(online, k)] for k in (5, 6, 7, 8)]
    for small, large in zip(ranks, ranks[1:], strict=False):
        assert all(a <= b for a, b in zip(small, large, strict=True))
