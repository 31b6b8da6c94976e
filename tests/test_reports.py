"""The report of a file: sections, bounded parts and one hash over all."""

from __future__ import annotations

import collections
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from changerisk import assess, tag_scripts
from changerisk.sources import reports
from changerisk.workload.verdicts import flat

SOURCES = {
    "a": "CREATE TABLE t (i int); DROP TABLE old; UPDATE t SET i = 1; "
         "DO $$ BEGIN EXECUTE 'x'; END $$; ALTER TABLE big ADD CHECK (i > 0)",
    "b": "SELECT 1; CREATE INDEX ix ON t (i)", "c": "",
}


@pytest.fixture(scope="module")
def made(spark):
    sources = spark.createDataFrame(list(SOURCES.items()), "file_id string, source string")
    assessed = assess(tag_scripts(sources), pg_version=17)
    statements = flat(assessed).cache()
    return {prose: reports.report_entries(assessed.parts, statements, online=False, sources=sources,
                                          prose=prose).cache() for prose in (True, False)}, statements


def test_sections(made):
    found = collections.defaultdict(list)
    for r in made[0][True].collect():
        found[r["file_id"], r["section"]].append((r["idx"], json.loads(r["document"])))
    statements = {(r["file_id"], r["idx"]): r for r in made[1].collect()}
    assert len(found["a", "statements"]) == 5 and len(found["b", "statements"]) == 2
    for (f, section), entries in found.items():
        for idx, doc in entries:
            assert list(doc) == sorted(doc)
            if section == "statements":
                row = statements[f, idx]
                assert (doc["index"], doc["classification"], doc["rationale"]) == (
                    idx, row["tier"], row["rationale"])
    head = found["a", "head"][0][1]
    tiers = collections.Counter(r["tier"] for (f, _), r in statements.items() if f == "a")
    assert {k: v for k, v in head["classification_counts"].items() if v} == dict(tiers)
    assert head["statements"] == 5 and head["online"] is False
    lost = [i for i, _ in found["a", "irreversible"]]
    assert lost == [i for (f, i), r in sorted(statements.items())
                    if f == "a" and r["reversibility"] == "irreversible"] and 1 in lost
    assert {d["role"] for _, d in found["a", "rollback"]} <= {"blocker", "undecided"}
    open_points = {d["source"] for _, d in found["a", "unverified"]}
    assert {"no_snapshot", "execution_state", "unknown_classification"} <= open_points
    assert any(d["level"] == 8 and d["relation"] == "old" for _, d in found["a", "locks"])
    assert found["a", "rules"] and found["c", "evidence"] and ("c", "head") not in found
    raw = SOURCES["a"].encode()
    assert found["a", "evidence"][0][1] == {
        "bytes": len(raw), "name": "change.sql", "sha256": hashlib.sha256(raw).hexdigest()}


def test_parts_hold_every_entry_once(made):
    entries = made[0][True]
    want = collections.Counter((r["file_id"], r["section"], r["document"]) for r in entries.collect())
    for size in (1, 2, 1000):
        parts = reports.section_parts(entries, size).collect()
        got = collections.Counter((p["file_id"], p["section"], json.dumps(
            d, separators=(",", ":"))) for p in parts for d in json.loads(p["body"]))
        assert sum(got.values()) == sum(want.values()) == sum(p["entries"] for p in parts)
        assert {k[:2] for k in got} == {k[:2] for k in want}
        assert all(hashlib.sha256(p["body"].encode()).hexdigest() == p["sha256"] for p in parts)


def roots(entries):
    return {(r["file_id"], r["section"]): r["report_sha256"] for r in
            reports.report_roots(reports.section_parts(entries)).collect()}


def test_one_changed_entry_moves_its_section_and_the_file(made):
    entries = made[0][True]
    before = roots(entries)
    assert before == roots(entries.repartition(7).orderBy(F.rand(3)))
    changed = entries.withColumn("document", F.when(
        (F.col("file_id") == "a") & (F.col("section") == "rules") & (F.col("idx") == 2),
        F.lit("{}")).otherwise(F.col("document")))
    after = roots(changed)
    assert {k for k in before if before[k] != after[k]} == {("a", "rules"), ("a", "")}


def test_coded_reports_do_not_depend_on_wording(made):
    for r in made[0][False].collect():
        assert not {"rationale", "reason", "what_is_lost"} & set(json.loads(r["document"]))
    assert reports.report_roots(reports.section_parts(made[0][False].where("false"))).collect() == []


def test_escapes_like_json(spark):
    """Few and many characters outside ASCII, pairs, control characters and backslashes."""
    many = "".join(chr(0x4E00 + i) + ("x" if i % 3 else "") for i in range(300))
    texts = ["", "plain", "é", "aé", "éa", "aébÿc", "\U0001f600", "a\U0001f600b\U0001f601\U0001f600",
             "é\U0001f600", many, many + "\U0001f600" + many, "\x0b\x0e\x1f é", "\\u001F", "\\\x1f",
             "\\\\u000B\x1a", 'q"\n\t', "é" * 100 + "ü", "́eﬁ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = rows.select("i", reports.canonical_json(F.struct("t")).alias("j")).collect()
    assert {r["i"]: r["j"] for r in got} == {
        i: json.dumps({"t": t}, separators=(",", ":")) for i, t in enumerate(texts)}
    none = spark.createDataFrame([(None,)], "t string").select(
        reports.escape_non_ascii(F.col("t")).alias("e")).first()["e"]
    assert none is None
