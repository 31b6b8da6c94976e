from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from changerisk.llm import ctph


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def slow_cuts(data):
    """Number of trailing zero bits after the first two, by place, where these are zero."""
    out = []
    for i in range(len(data)):
        roll = 0
        for back in range(ctph.WINDOW):
            value = data[i - back] if i >= back else 0
            roll = (roll + (value + 1) * pow(ctph._ROLL, back, 1 << 32)) % (1 << 32)
        mixed = (roll ^ (roll >> 15)) * 0x85EBCA6B % (1 << 32)
        mixed ^= mixed >> 13
        if mixed % 4 == 0:
            out.append((i, ((mixed >> 2) & -(mixed >> 2)).bit_length() - 1 if mixed >> 2 else 40))
    return out


def test_boundaries_by_hand():
    rng = random.Random(2)
    for n in (0, 1, 7, 60, 900, 3000):
        data = bytes(rng.choice(b"abcdefgh ") for _ in range(n))
        doubling, first, second = ctph.fingerprints([data])[0]
        cuts = slow_cuts(data)
        want = 0
        while sum(level >= want for _, level in cuts) >= ctph.LENGTH:
            want += 1
        assert doubling == want
        for least, signature in ((want, first), (want + 1, second)):
            at = [i for i, level in cuts if level >= least]
            assert len(signature) == len(at) + (n > 0 and (not at or at[-1] < n - 1))
            assert len(signature) <= ctph.LENGTH


def test_no_dependence_on_the_batch():
    rng = random.Random(4)
    data = [bytes(rng.choices(range(256), k=rng.randrange(400))) for _ in range(30)]
    together = ctph.fingerprints(data)
    assert together == [ctph.fingerprints([d])[0] for d in data]
    assert ctph.fingerprints([b"ab" * 50_000])[0][0] >= 0


def test_likeness_is_edit_distance():
    rng = random.Random(5)
    prints = ctph.fingerprints([bytes(rng.choices(b"abc", k=rng.randrange(1, 200)))
                                for _ in range(60)])
    pairs = [(rng.choice(prints), rng.choice(prints)) for _ in range(200)]
    for (a, b), got in zip(pairs, ctph.likeness(pairs), strict=True):
        common = ctph._common(a, b)
        if a == b:
            assert got == 1
        elif common is None:
            assert got == 0
        else:
            x, y = common
            assert got == pytest.approx(1 - slow_distance(x, y) / max(len(x), len(y), 1))


def test_edited_and_next(spark):
    rng = random.Random(6)
    rows = [(i, None if i % 17 == 3 else " ".join(rng.choices(["ab", "cde", "fé", "日本"],
            k=rng.randrange(120)))) for i in range(0, 140, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r for r in ctph.fingerprint_and_edit(docs).collect()}
    texts = [t or "" for _, t in rows]
    assert len(got) == len(rows)
    for i, (doc, _) in enumerate(rows):
        own, follow = texts[i], texts[(i + 1) % len(texts)]
        cut = len(own) // 4
        edited = own[:len(own) - cut] + follow[:cut]
        r = got[doc]
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = ctph.fingerprints([own.encode(), edited.encode(), follow.encode()])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (ctph.spelled(a), ctph.spelled(b))
        assert r["near_edited"] == pytest.approx(float(ctph.likeness([(a, b)])[0]))
        assert r["near_next"] == pytest.approx(float(ctph.likeness([(a, c)])[0]))


def test_odd_rows(spark, odd_docs, no_docs):
    got = ctph.fingerprint_and_edit(odd_docs.withColumn("place", F.lit(1)))
    assert got.count() == odd_docs.count()
    assert ctph.fingerprint_and_edit(no_docs).count() == 0
    one = spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")
    r = ctph.fingerprint_and_edit(one).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and r["near_next"] == 1
