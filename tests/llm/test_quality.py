from __future__ import annotations

import math
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from changerisk.llm import quality
from changerisk.llm.columns import held_out

BIG = "/root/testdata/sf0.01"


def slow_ftrl(rows, size, alpha=2.0, beta=1.0, l1=0.2, l2=1.0):
    """One pass, weight by weight."""
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def w(i):
        if i == size:
            return -z[i] * alpha / (beta + math.sqrt(n[i]))
        if abs(z[i]) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for x, y in rows:
        x = {**x, size: 1.0}
        now = {i: w(i) for i in x}
        p = 1 / (1 + math.exp(-sum(v * now[i] for i, v in x.items())))
        for i, v in x.items():
            g = (p - y) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * now[i]
            n[i] += g * g
    return z, n


def test_updates_weight_by_weight():
    rng = random.Random(5)
    rows = [({i: rng.random() for i in rng.sample(range(20), 6)}, rng.randint(0, 1))
            for _ in range(80)]
    fast = quality.Ftrl.empty(20)
    for x, y in rows:
        at = np.array(sorted(x))
        fast.update(at, np.array([x[i] for i in at]), y)
    z, n = slow_ftrl(rows, 20)
    assert np.allclose(fast.z, z) and np.allclose(fast.n, n)
    assert (fast.weights(slice(0, -1)) == 0).sum() > 0


def test_features_by_hand():
    f = quality.Features(bits=60)
    at, v = f.of("ab cd")
    assert at.size == 2 + 1 + 1 + 1 and math.isclose(float(v @ v), 1.0)
    # The shapes of both words are the same, so is a third word's that is new.
    assert np.isin(f.of("ab cd")[0], f.of("ab cd xy")[0]).all()
    # A repeated word has a shape of its own, whatever the word.
    again = set(f.of("ab ab")[0]) - set(f.of("ab cd")[0])
    assert len(again & set(f.of("cd cd")[0])) == 2
    assert f.of("Ab aB")[0].size and f.of(None)[0].size == f.of("")[0].size == f.of(" \n")[0].size == 0
    assert set(f.of("A1_$$")[0]) >= set(f.of("A")[0])


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality.train_and_score(
        docs, labels, held_out(F.col("doc_id"))).collect()}
    truth = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{BIG}/labels.parquet' "
                            "WHERE quality IS NOT NULL").fetchall())
    out = [(got[d]["score"], y) for d, y in truth.items() if got[d]["held_out"]]
    good, bad = [s for s, y in out if y], [s for s, y in out if not y]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad)
    assert wins > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def test_held_out_labels_do_not_matter(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text")
    labels = spark.range(7).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality")
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality"))
                               .otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.train_and_score(docs, x, held_out(F.col("doc_id"))).collect()),
                   key=repr) for x in (labels, turned))
    assert a == b


def test_shards_agree_with_slow_average(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(words[:5] if i % 2 else words[3:], k=9)), i % 2)
            for i in range(120)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = quality.train(sample, passes=2, shard=40, bits=8)
    keys = {d: xxhash.xxh64_intdigest(str(d)) for d, _, _ in rows}
    features = quality.Features(8)
    state = quality.Ftrl.empty(256)
    for turn in range(2):
        made = []
        for s in range(3):
            own = quality.Ftrl(state.z.copy(), state.n.copy())
            for d, t, y in sorted((r for r in rows if keys[r[0]] % 3 == s),
                                  key=lambda r: (keys[r[0]] ^ turn) * 0x9E3779B97F4A7C15 % 2**64):
                at, v = features.of(t)
                own.update(at, v.astype("float32").astype(float), y)
            made.append(own)
        state = quality.Ftrl(sum(m.z for m in made) / 3, sum(m.n for m in made) / 3)
    assert np.allclose(model.dense(), state.weights(slice(0, -1)), atol=1e-6)
    assert math.isclose(model.intercept, state.intercept(), abs_tol=1e-6)


@pytest.mark.parametrize("labels", ["none", "one class"])
def test_nothing_to_learn(spark, odd_docs, no_docs, labels):
    given = spark.range(5).selectExpr("id AS doc_id", "1 AS quality")
    model = quality.train(quality.labelled(odd_docs if labels == "one class" else no_docs, given))
    docs = odd_docs.withColumn("score", F.lit("mine")).withColumn("a.b", F.lit(1))
    out = quality.score(docs, model)
    assert out.columns == [c for c in docs.columns if c != "text"] + ["score_1", "predicted"]
    scores = {r["score_1"] for r in out.collect()}
    assert len(scores) == 1 and (scores == {0.5}) == (labels == "none")
    assert quality.score(no_docs, model).collect() == []


def test_repeated_and_null_labels(spark, odd_docs):
    given = spark.createDataFrame([(1, 0), (1, 1), (6, None), (None, 1), (3, 0)],
                                  "doc_id long, quality int")
    got = sorted(tuple(r) for r in quality.labelled(odd_docs, given).select("doc_id", "y").collect())
    assert got == [(1, 1), (1, 1), (1, 1), (3, 0)]
    assert quality.labelled(odd_docs, given, most=1).select("doc_id").distinct().count() == 1
