from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from changerisk.llm import mixing


def slow_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + (
        [None] if None in sizes else [])
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        level = left / sum(w[n] for n in free)
        full = {n for n in free if w[n] * level > most * sizes[n] + 1e-9}
        if not full:
            target |= {n: w[n] * level for n in free}
            break
        for n in full:
            target[n] = float(most * sizes[n])
            left -= target[n]
        free -= full
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 5, "c": 1000, None: 7}, {"x": 10}, {"a": 0, "b": 10, "é": 3}, {"a": 0},
    {f"s{i}": (i * 37) % 50 for i in range(30)}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(n, s) for n, s in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(slow_targets(sizes), abs=1e-6)


def test_mix_meets_every_target(spark):
    rows = [(i, "w " * (i % 17), f"s{min(i % 9, 4)}" if i % 11 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, carry=["doc_id", "source"]).collect()
    assert len(got) == 400
    taken, target = {}, {}
    for r in got:
        assert r["size"] == rows[r["doc_id"]][1].count("w")
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert taken == {s: int(t) for s, t in target.items()}
    again = mixing.mix(docs.repartition(7), carry=["doc_id", "source"]).collect()
    assert sorted(got) == sorted(again)


def test_repeated_keeps_columns(odd_docs, no_docs):
    docs = odd_docs.withColumn("size", F.lit("mine")).withColumn("target", F.lit(1))
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    plan = mixing.mix(odd_docs).collect()
    assert out.count() == sum(r["passes"] for r in plan)
    assert mixing.repeated(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0


def test_native_plan(odd_docs):
    plan = mixing.mix(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_names_the_input_has(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", -1, "p")],
                                 "doc_id long, text string, source string, size long, `a.b` string")
    row = mixing.mix(docs, carry=["doc_id", "size", "a.b"]).first()
    assert (row["size"], row["size_1"], row["taken"], row["a.b"]) == (-1, 3, 3, "p")
