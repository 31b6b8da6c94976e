"""Spelled names: parts, the canonical spelling, and relations found by them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from changerisk import tag_scripts
from changerisk.functions import names
from changerisk.operators import catalogs
from changerisk.operators.order import baseline_files, created_state


@pytest.mark.parametrize(("spelled", "parts", "canonical"), [
    ("Users", ["users"], "users"), ('"Users"', ["Users"], '"Users"'),
    ('app."Order.Lines"', ["app", "Order.Lines"], 'app."Order.Lines"'),
    ('App . "a""b"', ["app", 'a"b'], 'app."a""b"'), ('"safe_name"', ["safe_name"], "safe_name"),
    ('db."S".t1', ["db", "S", "t1"], 'db."S".t1'), ("", [], ""), (None, None, None),
])
def test_spellings(spark, spelled, parts, canonical):
    df = spark.createDataFrame([(spelled,)], "n string")
    got = df.select(names.name_parts(F.col("n")).alias("p"), names.canonical(F.col("n")).alias("c"),
                    names.schema_part(F.col("n")).alias("s"), names.own_part(F.col("n")).alias("o"),
                    names.last_spelled(names.canonical(F.col("n"))).alias("l")).first()
    assert got["p"] == parts and got["c"] == canonical
    assert got["s"] == (parts[-2] if parts and len(parts) > 1 else None)
    assert got["o"] == (parts[-1] if parts else None)
    if parts:
        assert got["l"] in (parts[-1], '"' + parts[-1].replace('"', '""') + '"')


def test_first_schema_of_the_path_wins(spark):
    spaces = spark.createDataFrame([(d, i, n) for d in (1, 2) for i, n in enumerate(
        ["public", "App", "audit"])], "db_id long, oid long, nspname string")
    classes = spark.createDataFrame(
        [(1, 10, "t", 0), (1, 11, "t", 1), (1, 12, "t", 2), (1, 13, "T", 0), (1, 14, "a.b", 2),
         (2, 20, "t", 2), (2, 21, "u", 1)],
        "db_id long, oid long, relname string, relnamespace long"
    ).selectExpr("*", "'r' AS relkind", "5L AS relpages", "-1L AS reltuples")
    asked = spark.createDataFrame(
        [(1, "t"), (1, "T"), (1, '"T"'), (1, "public.t"), (1, '"App".t'), (1, "App.t"),
         (1, '"a.b"'), (1, 'audit."a.b"'), (1, "a.b"), (2, "t"), (2, "u"), (3, "t")],
        "db_id long, requested string")

    def found(path):
        rows = catalogs.resolve_relations(asked, classes, spaces, path).collect()
        assert len(rows) == 12
        assert all(r["exists"] == (r["oid"] is not None) for r in rows)
        return {(r["db_id"], r["requested"]): r["oid"] for r in rows}

    fixed = {(1, '"T"'): 13, (1, "public.t"): 10, (1, '"App".t'): 11, (1, "App.t"): None,
             (1, 'audit."a.b"'): 14, (1, "a.b"): None, (3, "t"): None}
    assert found(("public",)) == {**fixed, (1, "t"): 10, (1, "T"): 10, (1, '"a.b"'): None,
                                  (1, '"T"'): 13, (2, "t"): None, (2, "u"): None}
    assert found(("App", "audit")) == {**fixed, (1, "t"): 11, (1, "T"): 11, (1, '"a.b"'): 14,
                                       (1, '"T"'): None, (2, "t"): 20, (2, "u"): 21}
    path = spark.createDataFrame([(1, "audit", 1), (1, "public", 2), (2, "App", 1)],
                                 "db_id long, nspname string, place int")
    assert found(path) == {**fixed, (1, "t"): 12, (1, "T"): 12, (1, '"a.b"'): 14, (1, '"T"'): 13,
                           (2, "t"): None, (2, "u"): 21}


def test_quoted_dotted_names_in_a_file(spark):
    source = ('CREATE TABLE app."Order.Lines" (id int); CREATE TABLE "lines" (id int);'
              'ALTER TABLE app."Order.Lines" RENAME TO "New.Name"; SELECT 1')
    tagged = tag_scripts(spark.createDataFrame([("f", source)], "file_id string, source string"))
    by_idx = {r["idx"]: r["targets"] for r in tagged.collect()}
    assert by_idx[0] == ['app."Order.Lines"'] and by_idx[1] == ["lines"]
    asked = spark.createDataFrame([("f", 3, 0, n) for n in (
        '"Order.Lines"', "lines", '"New.Name"', '"Lines"', "name")],
        "file_id string, idx long, inner_pos int, name string")
    state = {r["name"]: r["state"] for r in created_state(tagged, asked).collect()}
    assert state == {'"Order.Lines"': None, "lines": "clean", '"New.Name"': "clean",
                     '"Lines"': None, "name": None}


def test_baseline_tells_quoted_names_apart(spark):
    """Creating "A.T" settles that name, not T."""
    rows = [(f, 'CREATE TABLE x."A.T" (i int);' + "SELECT 1;" * 60 + f"ALTER TABLE {n} ADD c int")
            for f, n in (("same", 'y."A.T"'), ("other", "y.t"))]
    tagged = tag_scripts(spark.createDataFrame(rows, "file_id string, source string"))
    got = {r["file_id"]: r["baseline"] for r in baseline_files(tagged).collect()}
    assert got == {"same": True, "other": False}
