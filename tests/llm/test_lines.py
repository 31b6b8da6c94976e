from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from changerisk.llm import linededup


def slow(docs, block_ratio=(4, 5)):
    """Texts after removal, for documents with unique ids in order."""
    num, den = block_ratio
    seen, kept = [], {}
    for doc, text in docs:
        out = []
        for line in (text or "").split("\n"):
            words = line.split()
            if not words:
                out.append(line)
                continue
            tokens = frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) or frozenset(
                [tuple(words)])
            if not any(line == other or len(tokens & t) * (num + den)
                       >= (len(tokens) + len(t)) * num for other, t in seen):
                out.append(line)
            seen.append((line, tokens))
        kept[doc] = None if text is None else "\n".join(out)
    return kept


@pytest.mark.parametrize(("block", "ratio"), [(64, (4, 5)), (2, (4, 5)), (2, (1, 2))])
def test_like_brute_force(spark, monkeypatch, block, ratio):
    monkeypatch.setattr(linededup, "BLOCK", block)
    rng = random.Random(5)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 3, 6, 20, 40]))]
            for _ in range(12)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(5)):
            words = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"u{rng.randrange(500)}"
            lines.append(rng.choice(["", " "]) + rng.choice([" ", "  "]).join(words))
        docs.append((d, "\n".join(lines) if d % 13 else None))
    got = linededup.remove_lines(spark.createDataFrame(docs, "doc_id long, text string"),
                                 ratio=ratio).collect()
    assert {r["doc_id"]: r["text"] for r in got} == slow(docs, ratio)
    for r in got:
        assert r["n_lines"] == r["n_kept"] + r["n_equal"] + r["n_similar"]


def test_odd_rows(odd_docs, no_docs):
    clashing = odd_docs.withColumn("N_KEPT", F.lit("mine")).withColumn("line", F.lit(1))
    got = linededup.remove_lines(clashing)
    assert got.columns == [*clashing.columns, "n_lines", "n_kept_1", "n_equal", "n_similar"]
    rows = {(r["doc_id"], r["source"]): r for r in got.collect()}
    assert got.count() == odd_docs.count()
    assert rows[2, "a"]["text"] is None and rows[2, "a"]["n_lines"] == 0
    assert rows[3, None]["text"] == "" and rows[3, None]["n_lines"] == 1
    assert rows[4, "b"]["text"] == " \n\t "
    # Rows with equal id and text share their lines' fate: both keep theirs.
    assert rows[1, "a"]["n_kept_1"] == 2
    assert rows[None, "a"]["text"] == "no id at all here"
    assert rows[5, "a"]["n_kept_1"] == 1
    empty = linededup.remove_lines(no_docs)
    assert empty.count() == 0


def test_native_plan(spark, odd_docs):
    plan = linededup.remove_lines(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
