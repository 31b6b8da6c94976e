"""Cutting scripts into statements."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from changerisk.functions.tagging import split_statements, sums_before


@pytest.mark.parametrize(("source", "want"), [
    ("CREATE FUNCTION f() RETURNS int BEGIN ATOMIC SELECT 1; SELECT CASE WHEN a THEN 1 END; END; "
     "SELECT 2", ["CREATE FUNCTION f() RETURNS int BEGIN ATOMIC SELECT 1; SELECT CASE WHEN a THEN 1"
                  " END; END", "SELECT 2"]),
    ("create procedure p() begin atomic end; begin; commit",
     ["create procedure p() begin atomic end", "begin", "commit"]),
    ("SELECT 'begin atomic;'; SELECT b; BEGIN", ["SELECT 'begin atomic;'", "SELECT b", "BEGIN"]),
    ("-- b;\nSELECT \"a;b\" /* ; */; ;", ['SELECT "a;b"']),
    ("", []), (None, []),
    ("/* a /* b; */ c; */ SELECT 1", ["SELECT 1"]),
    ("SELECT '/* ; ' /* ; ' */ ; SELECT ' */ ; '", ["SELECT '/* ; '", "SELECT ' */ ; '"]),
    ("SELECT 2*/* ; */3; /*/* ; */*/ SELECT 4", ["SELECT 2* 3", "SELECT 4"]),
    ("/*/ ; /* ; */ ; */ SELECT 5 -- /* ;\n; SELECT 6", ["SELECT 5", "SELECT 6"]),
    ("SELECT a$b$ FROM t; SELECT $b$ ; $b$", ["SELECT a$b$ FROM t", "SELECT $b$ ; $b$"]),
])
def test_cuts(spark, source, want):
    df = spark.createDataFrame([("f", source)], "file_id string, source string")
    got = sorted((r["idx"], r["sql"]) for r in split_statements(df).collect())
    assert [sql for _, sql in got] == want


def server_cuts(text):
    """Statements as a server's lexer cuts them, character by character."""
    out, now, i = [], "", 0
    while i < len(text):
        rest = text[i:]
        if rest.startswith("--"):
            end = rest.find("\n")
            now, i = now + " ", len(text) if end < 0 else i + end
        elif rest.startswith("/*"):
            depth, j = 0, i
            while True:
                if text.startswith("/*", j):
                    depth, j = depth + 1, j + 2
                elif text.startswith("*/", j):
                    depth, j = depth - 1, j + 2
                    if not depth:
                        break
                else:
                    j += 1
            now, i = now + " ", j
        elif rest[0] in "'\"":
            j = i + 1
            escaped = rest[0] == "'" and text[i - 1:i] in ("e", "E") and not (
                text[i - 2:i - 1].isalnum() or text[i - 2:i - 1] in ("_", "$"))
            while text[j] != rest[0]:
                j += 2 if escaped and text[j] == "\\" else 1
            now, i = now + text[i:j + 1], j + 1
        elif rest[0].isalpha() or rest[0] == "_":
            word = re.match(r"[\w$]+", rest).group()
            now, i = now + word, i + len(word)
        elif rest[0] == "$":
            tag = rest[:rest.find("$", 1) + 1]
            j = text.index(tag, i + len(tag)) + len(tag)
            now, i = now + text[i:j], j
        elif rest[0] == ";":
            out, now, i = [*out, now], "", i + 1
        else:
            now, i = now + rest[0], i + 1
    return [" ".join(x.split()) for x in [*out, now] if x.split()]


def nested(rng, depth):
    inside = [rng.choice([" ; ", "'", '"', " a\n", "--", "$$", "*", "/ "]) for _ in range(3)]
    if depth:
        inside.insert(rng.randrange(4), nested(rng, depth - 1))
    return "/*" + " ".join(inside) + " */"


def test_generated_scripts(spark):
    rng = random.Random(8)

    def part():
        return rng.choice([
            lambda: nested(rng, rng.randrange(5)), lambda: ";", lambda: " ; ", lambda: "\n",
            lambda: "'a; /* ''b */'", lambda: '"c; /* d"', lambda: "-- e; /* f\n",
            lambda: " E'\\'; /*'", lambda: "$$ g; */ $$", lambda: " $t$ /* ; $$ $t$ ",
            lambda: "h$i$ ", lambda: "2*/* ; */3", lambda: "SELECT 1", lambda: " x / y * z - 1 "])()

    rows = [(str(i), "".join(part() for _ in range(rng.randrange(1, 14)))) for i in range(1500)]
    got = {}
    for r in split_statements(spark.createDataFrame(rows, "file_id string, source string")).collect():
        got.setdefault(r["file_id"], []).append((r["idx"], r["sql"]))
    for key, source in rows:
        found = sorted(got.get(key, []))
        assert [sql for _, sql in found] == server_cuts(source), source
        assert [i for i, _ in found] == list(range(len(found)))


def test_deep_and_long_comments(spark):
    deep = "/* " * 300 + " ; " + "*/ " * 300 + "; SELECT 1"
    long = "/* " + "* // ; /* x */ '\n" * 20_000 + "*/ SELECT 2; SELECT 3"
    open_ = "SELECT 4; /* a /* b */ ; SELECT 5"
    df = spark.createDataFrame([("deep", deep), ("long", long), ("open", open_)],
                               "file_id string, source string")
    got = sorted((r["file_id"], r["idx"], r["sql"]) for r in split_statements(df).collect())
    assert got[:3] == [("deep", 0, "SELECT 1"), ("long", 0, "SELECT 2"), ("long", 1, "SELECT 3")]
    assert [g[2] for g in got[3:]] == ["SELECT 4", "/* a", "SELECT 5"]


def test_lines_and_no_exchange(spark):
    source = "".join(f"SELECT {i} /* ;\n */;{chr(10) * (i % 3)}" for i in range(2000))
    df = split_statements(spark.createDataFrame([("f", source)], "file_id string, source string"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r["idx"]: r["line"] for r in df.collect()}
    line, want = 1, {}
    for i in range(2000):
        want[i] = line
        line += 1 + ((i - 1) % 3 if i else 0)  # blanks after a semicolon lead the next piece
    assert got == want
    for n in (0, 1, 2, 17):
        sums = spark.range(1).select(sums_before(F.array(*[F.lit(k) for k in range(n)])
                                                 .cast("array<int>"))).first()[0]
        assert sums == [sum(range(k)) for k in range(n)]
