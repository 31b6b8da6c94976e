from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from changerisk.llm import negatives
from changerisk.llm.negatives import Vectors

ROWS = "vec_id long, embedding array<float>, label int"


def slow(rows, is_anchor, positives=5, count=10):
    """All scores by hand; ``rows``: ``(id, label, x)``."""
    out = []
    for a, la, x in rows:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(u * v for u, v in zip(x, y, strict=False)), i, lb == la)
                        for i, lb, y in rows if i != a)
        for p, pid, _ in [s for s in scored if s[2]][:positives]:
            p = -p
            fit = [s for s in scored if not s[2] and 30 * p <= -100 * s[0] <= 90 * p]
            out += [(a, pid, k + 1, i, p, -s) for k, (s, i, _) in enumerate(fit[:count])]
    return sorted(out)


def clustered(n, width, seed):
    """Vectors around a few far points, of many lengths: the pruning has work."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width)) ** 3
    which = rng.integers(0, 6, n)
    x = centres[which] + 0.15 * rng.normal(size=(n, width))
    x *= rng.lognormal(0, 0.8, size=(n, 1))
    return np.floor(256 * x / np.abs(x).max()).astype(np.int64), rng.integers(0, 3, n)


@pytest.mark.parametrize("whole", [0.0, 0.25, 1.0])
def test_candidates_miss_no_row(whole):
    x, labels = clustered(500, 12, 4)
    rows = Vectors(np.arange(500), labels, x)
    anchors = rows.part(np.arange(0, 500, 20))
    exact = anchors.x @ rows.x.T
    pruned = 0
    for share in (0.2, 0.6, 0.9, 0.99):
        least = (share * exact.max(axis=1)).astype(np.int64)
        dense, some = negatives.candidates(anchors, rows, least, whole=whole)
        found = {int(a): set(range(500)) for a in dense} | {a: set(r.tolist()) for a, r in some}
        for a in range(anchors.ids.size):
            assert set(np.flatnonzero(exact[a] >= least[a])) <= found.get(a, set())
        pruned += sum(len(r) < 250 for _, r in some)
    assert (pruned > 0) == (whole > 0)


def test_candidates_leave_out_short_buckets():
    anchors = Vectors(np.array([1]), np.array([0]), np.array([[10, 0]]))
    short = Vectors(np.array([2]), np.array([0]), np.array([[3, 4]]))
    dense, some = negatives.candidates(anchors, short, np.array([51]))
    assert dense.size == 0 and some == []


def test_products_are_exact_at_any_size():
    for most in (100, 1 << 27, 1 << 40):
        a = Vectors.of([1], [0], [[most, -most, 3]])
        b = Vectors.of([2], [0], [[most, most - 1, 1]])
        want = most * most - most * (most - 1) + 3
        assert negatives.products(a, b)[0, 0] == want
    big = Vectors.of([1], [0], [[1 << 60, 1 << 60]])
    assert negatives.products(big, big)[0, 0] == (1 << 63) - 1


@pytest.mark.parametrize(("round_size", "bucket"), [(1000, 4096), (7, 50)])
def test_against_brute_force(spark, round_size, bucket, monkeypatch):
    monkeypatch.setattr(negatives, "TOGETHER", 4)
    x, labels = clustered(400, 8, 9)
    x[10:60] = x[10]  # equal vectors: ties go by id
    rows = [(i, int(labels[i]), x[i].tolist()) for i in range(400)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "id long, label long, x array<long>")
    out = negatives.mine(df, F.col("id") % 20 == 0, round_size=round_size, bucket=bucket)
    got = sorted(tuple(r) for r in out.collect())
    assert got == slow(rows, lambda i: i % 20 == 0) and len(got) > 200


def test_rows_that_take_no_part(spark):
    inf, nan = math.inf, math.nan
    rows = [(0, [1.0, 0.5], 1), (1, [0.9, 0.1], 1), (2, [0.5, 0.2], 2), (3, None, 1),
            (4, [nan, 1.0], 2), (5, [inf, 1.0], 2), (6, [None, 1.0], 2), (7, [1.0, 1.0], None),
            (None, [1.0, 1.0], 2), (8, [], 2), (9, [0.6], 2), (2, [0.5, 0.2], 2), (10, [-0.001, 0.0], 1)]
    df = spark.createDataFrame(rows, ROWS).withColumn("id", F.lit("mine")).withColumn("x", F.lit(0))
    got = negatives.whole_vectors(df, key="vec_id", vector="embedding", label=F.col("label"))
    assert sorted(tuple(r) for r in got.collect()) == [
        (0, 1, [256, 128]), (1, 1, [230, 25]), (2, 2, [128, 51]), (8, 2, []), (9, 2, [153]),
        (10, 1, [-1, 0])]
    kept = [(i, lb, x) for i, lb, x in map(tuple, got.collect())]
    out = negatives.mine(got, F.col("id") == 0)
    assert sorted(tuple(r) for r in out.collect()) == slow(kept, lambda i: i == 0) != []
    none = negatives.mine(got.where("false"), F.col("id") == 0)
    assert none.collect() == [] and none.columns[0] == "anchor_id"
    assert negatives.mine(got, F.col("id") == 77).collect() == []
