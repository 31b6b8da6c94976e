from __future__ import annotations

import collections
import hashlib

import duckdb
import numpy as np
import pytest
import tokenizers
from conftest import SF_DIR
from hypothesis import given, settings
from hypothesis import strategies as st

from changerisk.llm import alignment
from changerisk.llm.queries import QUERIES


@pytest.fixture(scope="module")
def vocabularies():
    return alignment.ByteBpe.load(), alignment.PieceModel.load()


@pytest.fixture(scope="module")
def reference_bpe():
    found = tokenizers.Tokenizer.from_file(alignment.BYTE_BPE)
    found.encode_special_tokens = True
    return found


def slow_groups(one, two, a, b):
    """Groups, links by place, of two token lists, byte by byte."""
    owner_a = [i for i, x in enumerate(a) for _ in one[x]]
    owner_b = [i for i, x in enumerate(b) for _ in two[x]]
    links = sorted(set(zip(owner_a, owner_b, strict=True)))
    ends_a = set(np.cumsum([len(one[x]) for x in a]).tolist())
    ends_b = set(np.cumsum([len(two[x]) for x in b]).tolist())
    groups, begin = [], 0
    for end in sorted(ends_a & ends_b):
        groups.append(([a[i] for i in dict.fromkeys(owner_a[begin:end])],
                       [b[i] for i in dict.fromkeys(owner_b[begin:end])], end))
        begin = end
    return groups, links


def slow_counts(texts, one, two, encode):
    """The operator's columns of every text, without arrays or Spark."""
    made = []
    for t in texts:
        a, b = encode(t) if t else ([], [])
        if b"".join(one[x] for x in a) != b"".join(two[x] for x in b) or not t:
            a, b = [], []
        made.append((a, b, *slow_groups(one, two, a, b)))
    held = collections.Counter()
    for a, b, _, links in made:
        held.update({(a[i], b[j]) for i, j in links})
    most = collections.defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for a, b, groups, links in made:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y, _ in groups)
        counts = [held[a[i], b[j]] for i, j in links]
        out.append((len(a), len(b), len(groups), len(links),
                    sum(held[a[i], b[j]] == most[a[i]] for i, j in links), sum(counts),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 400), unique=True), st.lists(st.integers(0, 400)),
       st.integers(2, 20))
def test_gallop_is_a_rank(hay, needles, block):
    hay, needles = np.array(sorted(hay), dtype=np.int64), np.array(sorted(needles), dtype=np.int64)
    assert alignment.gallop(hay, needles, block).tolist() == np.searchsorted(hay, needles).tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=60), st.randoms())
def test_overlap_byte_by_byte(sizes, random):
    """Two random cuts of the same bytes."""
    total = sum(sizes)
    a = np.cumsum(sizes)
    b = np.array(sorted({*random.sample(range(1, total + 1), random.randint(1, total)), total}))
    got = alignment.overlap(a, b)
    owner = [np.searchsorted(x, np.arange(1, total + 1)) for x in (a, b)]
    want = sorted(set(zip(owner[0].tolist(), owner[1].tolist(), strict=True)))
    assert sorted(zip(got.link_a.tolist(), got.link_b.tolist(), strict=True)) == want
    assert a[got.cut_a].tolist() == b[got.cut_b].tolist() == sorted({*a.tolist()} & {*b.tolist()})
    # A group of p and q tokens has p + q - 1 links.
    assert got.link_a.size == a.size + b.size - got.cut_a.size


def test_byte_bpe_gives_the_files_ids(vocabularies, reference_bpe):
    """Every token is one token by itself, so merging by ranks is the file's own merging."""
    one = vocabularies[0]
    words = reference_bpe.get_vocab(with_added_tokens=False)
    assert all([x.id for x in reference_bpe.model.tokenize(w)] == [i] for w, i in words.items()
               if i < len(one.tokens))
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF_DIR}/documents.parquet'").fetchall()]
    texts += ["<|endoftext|> x", " ", "a\x00b", "日本語 ١٢٣ ǅ x", "it's WE'LL\t\t\n x", "é" * 999]
    want = [e.ids for e in reference_bpe.encode_batch([" " + t for t in texts],
                                                      add_special_tokens=False)]
    assert one.encode(texts) == want


def test_query_against_brute_force(spark, vocabularies, reference_bpe):
    one, two = vocabularies
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet' ORDER BY 1").fetchall()

    def encode(t):
        return (reference_bpe.encode(" " + t, add_special_tokens=False).ids, two.encode([t])[0])

    want = dict(zip([r[0] for r in rows], slow_counts(
        [r[1] for r in rows], one.tokens, two.tokens, encode), strict=True))
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_token_alignment"](spark, SF_DIR).collect()}
    assert got == want


def test_odd_rows(spark, odd_docs, no_docs, vocabularies, monkeypatch):
    monkeypatch.setattr(alignment, "STRETCH", 64)
    one, two = vocabularies
    docs = odd_docs.selectExpr("*", "1 AS n_a", "text AS `k0`", "doc_id AS `a.b`")
    rows = docs.collect()
    want = slow_counts([r["text"] for r in rows], one.tokens, two.tokens,
                       lambda t: (one.encode([t])[0], two.encode([t])[0]))
    out = alignment.aligned_counts(docs, one, two)
    assert out.columns == [c for c in docs.columns if c != "text"] + [
        "n_a_1", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = collections.Counter(tuple(r) for r in out.collect())
    assert got == collections.Counter(
        tuple(r[c] for c in docs.columns if c != "text") + w for r, w in zip(rows, want, strict=True))
    marked = [w for r, w in zip(rows, want, strict=True) if r["text"] and "▁" in r["text"]]
    assert marked == [(0, 0, 0, 0, 0, 0, "")]
    assert alignment.aligned_counts(no_docs, one, two).collect() == []
    assert alignment.align(no_docs, one, two).collect() == []


def test_spans(spark, odd_docs, vocabularies):
    one, two = vocabularies
    docs = odd_docs.where("length(text) < 1000 OR text IS NULL")
    for r in alignment.align(docs, one, two, keep=["doc_id", "text"]).collect():
        t = r["text"]
        if not t or "▁" in t:
            assert r["groups"] == []
            continue
        want, _ = slow_groups(one.tokens, two.tokens, one.encode([t])[0], two.encode([t])[0])
        assert [(g["a"], g["b"], g["end"]) for g in r["groups"]] == want
