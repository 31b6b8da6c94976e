from __future__ import annotations

import collections
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from changerisk.llm import gumbel
from changerisk.llm.gumbel import Decoder, Sampler, Vocabulary

SMALL = Vocabulary(
    (("<unk>", "other"), ("<0x0A>", "byte"), ("▁", "piece"), ("▁a", "piece"), ("a", "piece"),
     ("b", "piece"), ("ab", "piece"), ("ba", "piece"), ("▁ab", "piece"), ("c", "piece"),
     ("a▁b", "piece")),
    (0, 0, -2, -1.5, -2, -2.2, -1, -1.3, -1.1, -3, 0))


def all_paths(text, sampler):
    """Every segmentation and its log probability."""
    marked = "▁" + text.replace(" ", "▁")
    log_p = {p: (i, sampler.log_p[i]) for i, (p, kind) in enumerate(SMALL.pieces)
             if kind == "piece" and p != "a▁b"}
    found = {}

    def walk(at, ids, value):
        if at == len(marked):
            found[tuple(ids)] = value
        for p, (i, w) in log_p.items():
            if marked.startswith(p, at) and at < len(marked):
                walk(at + len(p), [*ids, i], value + w)
        if marked[at:at + 1] == "\n":
            walk(at + 1, [*ids, 1], value + sampler.least)

    walk(0, [], 0.0)
    total = np.logaddexp.reduce(list(found.values()))
    return {k: v - total for k, v in found.items()}


def test_draws_are_without_replacement():
    text, n = "abab ba\nab", 6000
    sampler = Sampler(SMALL)
    chance = {k: math.exp(v) for k, v in all_paths(text, sampler).items()}
    drawn = sampler.sample([text] * n, list(range(1000, 1000 + n)), 3, 1.0)
    expected = [collections.Counter() for _ in range(3)]
    for a, p in chance.items():
        expected[0][a] += p
        for b, q in chance.items():
            if b != a:
                second = p * q / (1 - p)
                expected[1][b] += second
                for c, r in chance.items():
                    if c not in (a, b):
                        expected[2][c] += second * r / (1 - p - q)
    for place in range(3):
        seen = collections.Counter(tuple(d[place][0].tolist()) for d in drawn)
        for path, p in expected[place].items():
            assert abs(seen[path] / n - p) < 5 * math.sqrt(p / n) + 1e-3
    for d in drawn:
        assert len({tuple(x[0].tolist()) for x in d}) == 3
        assert d[0][2] > d[1][2] > d[2][2]
        for ids, log_prob, _, inclusion in d:
            assert math.exp(log_prob) == pytest.approx(chance[tuple(ids.tolist())])
            assert 0 < inclusion <= 1
            assert Decoder(SMALL).decode(ids) == text
    # Importance weights: probability over inclusion sums up to 1 on average.
    total = np.mean([sum(math.exp(x[1]) / x[3] for x in d) for d in drawn])
    assert total == pytest.approx(1, abs=0.05)


def test_all_segmentations_if_few():
    sampler = Sampler(SMALL)
    drawn = sampler.sample(["ab"], [3], 50, 1.0)[0]
    assert {tuple(x[0].tolist()) for x in drawn} == set(all_paths("ab", sampler))
    assert {x[3] for x in drawn} == {1.0}


def test_batches_make_no_difference():
    sampler = Sampler(SMALL)
    texts = ["abab ba\nab", "", "a b", "abab ba\nab", "bab" * 50]
    together = sampler.sample(texts, [1, 2, 3, 1, 5], 3, 1.0)
    alone = [sampler.sample([t], [s], 3, 1.0)[0] for t, s in zip(texts, [1, 2, 3, 1, 5], strict=True)]
    for x, y in zip(together, alone, strict=True):
        assert [a[0].tolist() for a in x] == [a[0].tolist() for a in y]
        assert [a[2] for a in x] == pytest.approx([a[2] for a in y])
    assert [a[0].tolist() for a in together[0]] == [a[0].tolist() for a in together[3]]


def test_real_vocabulary_round_trip(spark, odd_docs, no_docs):
    vocabulary = Vocabulary.load()
    docs = odd_docs.withColumn("ids", F.lit("mine"))
    encoded = gumbel.encode(docs, vocabulary, keep=["doc_id", "text", "ids"], k=3)
    assert encoded.columns == ["doc_id", "text", "ids", "sample", "ids_1", "log_prob", "perturbed",
                               "inclusion"]
    back = gumbel.decode(encoded, vocabulary, ids="ids_1").collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    counts = collections.Counter(r["doc_id"] for r in back)
    assert counts[2] == counts[3] == 1 and counts[5] == 3 and counts[1] == 9
    assert all(r["log_prob"] <= 0 and 0 <= r["inclusion"] <= 1 for r in back)
    assert gumbel.encode(no_docs, vocabulary).count() == 0
    ids = encoded.select(F.when(F.col("sample") == 1, F.col("ids_1")).alias("ids"))
    assert gumbel.decode(ids, vocabulary).where("ids is null and decoded is not null").count() == 0


def test_decoding_holds_the_texts_of_a_part_alone():
    vocabulary = Vocabulary.load()
    decoder, piece = Decoder(vocabulary), vocabulary.pieces.index(("▁the", "piece"))
    rows = [[piece] * n for n in (30_000, 30_000, 0, 30_000, 90_000, 5)] + [None, [piece]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(rows))), pa.array(rows, pa.list_(pa.int32()))], names=["n", "ids"])
    parts = list(gumbel.decoded_parts(batch.slice(1), decoder, "ids", "text"))
    assert [p.column("n").to_pylist() for p in parts] == [[1, 2, 3], [4], [5, 6, 7]]
    assert all(p.num_rows == 1 or pc.sum(pc.list_value_length(
        p.column("ids"))).as_py() <= gumbel.IDS for p in parts)
    made = [x for p in parts for x in p.column("text").to_pylist()]
    assert made == [None if r is None else " ".join(["the"] * len(r)) for r in rows[1:]]
    assert not list(gumbel.decoded_parts(batch.slice(0, 0), decoder, "ids", "text"))


def test_a_group_is_one_lattice(monkeypatch):
    built = []

    class Counted(gumbel._Lattice):
        def __init__(self, sampler, texts, alpha):
            built.append(sum(len(t) + 1 for t in texts))
            super().__init__(sampler, texts, alpha)

    monkeypatch.setattr(gumbel, "CHARS", 100)
    monkeypatch.setattr(gumbel, "_Lattice", Counted)
    lengths = [39, 39, 39, 0, 19, 250, 0, 99, 5]
    texts, at, groups = ["ab" * (n // 2) + "a" * (n % 2) for n in lengths], 0, []
    while at < len(texts):
        to = gumbel.group_end(lengths[at:], at)
        groups.append((at, to))
        Sampler(SMALL).sample(texts[at:to], [1] * (to - at), 2, 1.0)
        at = to
    assert groups == [(0, 2), (2, 5), (5, 6), (6, 7), (7, 8), (8, 9)]
    assert built == [80, 61, 251, 1, 100, 6]
    built.clear()
    Sampler(SMALL).sample(texts, [1] * len(texts), 2, 1.0)
    assert built == [80, 61, 251, 1, 100, 6]
