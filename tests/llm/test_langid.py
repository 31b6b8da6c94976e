from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

from changerisk.llm import langid
from changerisk.llm.columns import held_out

SF = "/root/testdata/sf0.01"


def slow_ngrams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    counts = collections.Counter()
    for w in words:
        padded = f"\x01{w}\x01"
        counts.update(w)
        for n in (2, 3):
            counts.update(padded[i:i + n] for i in range(len(padded) - n + 1))
    return counts


def code(gram):
    return sum(ord(c) << (langid.BITS * (2 - i)) for i, c in enumerate(gram))


def test_ngrams_by_hand():
    for text in ("", "12 !", "a", "The  cat's\nHÜT", "ab-cd"):
        got = collections.Counter(langid.ngrams(langid.symbols(text)).tolist()) \
            if langid.symbols(text).size else collections.Counter()
        assert got == {code(g): n for g, n in slow_ngrams(text).items()}


def test_out_of_place_by_hand(spark):
    texts = [("en", "the cat and the dog"), ("de", "der hund und die katze"), (None, "x")]
    docs = spark.createDataFrame(texts, "lang string, text string")
    learned = langid.profiles(langid.count_ngrams(docs), 20)
    profile = {}
    for r in learned.collect():
        profile.setdefault(r["lang"], {})[r["ngram"]] = r["rank"]
    for lang, text in texts[:2]:
        counts = slow_ngrams(text)
        order = sorted(((-n, code(g)) for g, n in counts.items()))[:20]
        assert profile[lang] == {g: i for i, (_, g) in enumerate(order)}
    known = langid.Profiles([tuple(r) for r in learned.select("lang", "ngram", "rank").collect()],
                            20)
    for text in ("the hat", "die maus und der", "zzz"):
        order = [g for _, g in sorted((-n, code(g)) for g, n in slow_ngrams(text).items())[:20]]
        out = {lang: sum(abs(ranks[g] - i) if g in ranks else 20 for i, g in enumerate(order))
               for lang, ranks in profile.items()}
        best, worst = sorted(out.values())
        lang, score = known.predict(text)
        assert out[lang] == best and score == pytest.approx(1 - best / worst)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.train_and_identify(docs, held_out(F.col("doc_id"))).join(
        docs.select("doc_id", "lang"), "doc_id")
    right, total = got.where("held_out").agg(
        F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert total > 100 and right / total > 0.95
    assert got.where("score < 0 or score > 1").count() == 0


def test_odd_rows(odd_docs, no_docs):
    learned = langid.profiles(langid.count_ngrams(odd_docs))
    docs = odd_docs.withColumn("score", F.lit("mine"))
    got = langid.identify(docs, learned)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "score", "lang_pred", "score_1"]
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 4)} == {"und"}
    nothing = langid.profiles(langid.count_ngrams(no_docs))
    assert {r["lang_pred"] for r in langid.identify(odd_docs, nothing).collect()} == {"und"}
    assert langid.identify(no_docs, learned).count() == 0
