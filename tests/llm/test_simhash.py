from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from changerisk.llm import linededup, simhash
from changerisk.llm.components import components


def slow_fingerprint(text, n):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
             .translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(nodes, linked):
    name = {}
    for start in sorted(nodes):
        if start in name:
            continue
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in name:
                name[x] = start
                todo += [y for y in nodes if y not in name and linked(x, y)]
    return name


@pytest.mark.parametrize("text", ["", " \t", "One", "a B", "a b c", "A b c d a b c", "é È x\ny\x0bz"])
def test_fingerprint(spark, text):
    for n in (3, 5):
        assert simhash.fingerprint(text, n) & (1 << 64) - 1 == slow_fingerprint(text, n)
    one = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert simhash.fingerprint("a b c") == one


@pytest.mark.parametrize(("distance", "paired"), [(2, 48), (2, 1), (4, 3)])
def test_links_connect_like_brute_force(spark, distance, paired):
    rng = random.Random(7 + distance)
    prints = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 12])):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(simhash._signed(x))
    df = spark.createDataFrame([(p, p) for p in prints], "id long, fp long")
    links = simhash.neighbour_links(df, distance, paired)
    found = {r["node"]: r["component"] for r in components(links).collect()}
    near = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count() <= distance
    assert {p: found.get(p, p) for p in prints} == reach(prints, near)


def test_layout_sums_up():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (500, 64)).astype(float)
    for distance in (2, 4):
        groups, thresholds = simhash.layout(500, bits.T @ bits, distance)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(thresholds) == distance - len(groups) + 1
        assert min(thresholds) >= -1


def test_odd_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_text = {}
    for r, s in zip(sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"]) for r in got), got,
                    strict=True):
        by_text[s["fp"]] = s["component_id"]
        assert r is not None
    assert by_text[0] == 2
    assert simhash.near_duplicates(no_docs).count() == 0


def test_keep_one(odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs.withColumn("fp", F.lit("mine")), words=5)
    assert kept.columns == [*odd_docs.columns, "fp"]
    rows = kept.collect()
    # 2, 3, 4 and the null row have no words; the repeated row 1 stays once.
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [
        (False, 1), (False, 1), (False, 2), (False, 5), (False, 6), (True, 0)]
    assert simhash.keep_one(no_docs).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000), (None, 7)]
    got = {r["node"]: r["component"] for r in components(
        spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(400)} | {5000: 5000}


def test_keep_one_like_brute_force_jaccard(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(14):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([4, 30, 100, 400]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
                copy[rng.randrange(len(copy))] = f"u{rng.randrange(9000)}"
            texts.append(rng.choice([" ", "\n"]).join(copy))
    # A chain: the ends resemble the middle, not each other.
    base = [f"c{i}" for i in range(200)]
    texts += [" ".join(base[k:k + 180]) for k in (0, 10, 20)]
    # One replaced word in 100.
    hundred = [f"h{i}" for i in range(100)]
    texts += [" ".join(hundred), " ".join(hundred[:50] + ["other"] + hundred[51:])]
    rng.shuffle(texts)

    def shingles(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    want = sorted(set(reach(sets, near).values()))
    got = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)),
                                                 "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == want
    assert len(want) < len(texts)


def test_keep_one_takes_close_fingerprints_first(spark, monkeypatch):
    """Close fingerprints give the first candidates; the exact check and the join decide."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(9000)}" for _ in range(600)]
    turned = base[300:] + base[:300]  # four shingles of 600 differ at the cut and the ends
    other = [f"v{rng.randrange(9000)}" for _ in range(600)]
    many = [f"x{i}" if i % 60 == 0 else w for i, w in enumerate(base)]  # Jaccard 0.84
    texts = [" ".join(t) for t in (base, base + ["end"], turned, other, many)]
    docs = spark.createDataFrame([*enumerate(texts), (9, texts[0].upper()), (None, texts[3])],
                                 "doc_id long, text string")
    prints = [slow_fingerprint(t, 5) for t in texts]
    close = {(b, a) for b in range(5) for a in range(b)
             if (prints[a] ^ prints[b]).bit_count() <= 2}
    assert close and (4, 0) not in close

    seen, real = [], simhash.close_pairs

    def watched(*args, **kwargs):
        got = real(*args, **kwargs)
        seen.extend((r["line"]["key"], r["match"]["key"]) for r in got.collect())
        return got

    monkeypatch.setattr(simhash, "close_pairs", watched)
    kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    # Of the two spellings of one class the first in the join's order stands for both.
    assert reach(range(5), lambda a, b: (max(a, b), min(a, b)) in close) == reach(
        range(5), lambda a, b: (max(a, b), min(a, b)) in {
            (max(p), min(p)) for p in seen if None not in p})
    assert sorted(kept) == [0, 3]


def test_keep_one_compares_a_crowded_posting_in_blocks(spark, monkeypatch):
    """Three of six passages in every text, and a copy of each with one other word."""
    monkeypatch.setattr(linededup, "BLOCK", 2)
    texts = [[f"{p}{i}" for p in some for i in range(60)] for some in combinations("abcdef", 3)]
    texts += [[*w[:20], "other", *w[21:]] for w in texts]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in texts]
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    want = sorted(set(reach(range(len(texts)), near).values()))
    rows, real = [], linededup.LineJoin._in_blocks

    def watched(self, *args, **kwargs):
        got = real(self, *args, **kwargs)
        rows.append(got.where("size(similar) > 0").count())
        return got

    monkeypatch.setattr(linededup.LineJoin, "_in_blocks", watched)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)],
                                 "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == want
    assert 1 < len(want) < len(texts) and rows[0] > 0
