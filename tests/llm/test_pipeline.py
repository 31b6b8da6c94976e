from __future__ import annotations

import collections
import re

from conftest import SF_DIR
from pyspark.sql import functions as F
from llm.test_lines import slow
from llm.test_mixing import slow_targets
from llm.test_simhash import reach

import corpus_pipeline
from changerisk.llm import gumbel, toxicity
from changerisk.llm.columns import held_out

BIGGER = "/root/testdata/sf0.01"


def shingles(text):
    """Five-word shingles, A-Z as a-z; fewer words are one, none is nothing."""
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWERED))
    if len(words) < 5:
        return frozenset([" ".join(words)]) if words else frozenset()
    return frozenset(" ".join(words[i:i + 5]) for i in range(len(words) - 4))


def similar(a, b):
    """Texts without words count as equal."""
    return 5 * len(a & b) >= 4 * len(a | b)


LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_near_duplicates_of_raw_documents(spark):
    """At sf0.01 copies with small changes stand in the raw texts, so a looser rule shows."""
    docs = spark.read.parquet(f"{BIGGER}/documents.parquet")
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    group = reach(sets, lambda a, b: similar(sets[a], sets[b]))
    got = corpus_pipeline.drop_near_duplicates(spark, docs, BIGGER)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(group.values()))
    assert len(set(group.values())) < len(sets)


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("sample", F.lit("mine"))
    columns = docs.columns
    inputs, outputs = [], []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append({r["doc_id"]: r for r in docs.collect()})
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        outputs.append(docs.collect())
        if i < 4:
            assert docs.columns == columns

    # Toxicity: what the grammar rejects goes, all else stays as it is.
    first = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    grammar = toxicity.train(first, labels, held_out(labels["doc_id"]))
    want = {d: r for d, r in inputs[0].items() if grammar.score(grammar.weight(r["text"])) < 0.5}
    assert {r["doc_id"]: r for r in outputs[0]} == want
    assert 0 < len(want) <= len(inputs[0])

    # Lines: every document stays, later matches are gone.
    texts = sorted((d, r["text"]) for d, r in inputs[1].items())
    assert {r["doc_id"]: r["text"] for r in outputs[1]} == slow(texts)

    # Near duplicates: the smallest id of every component of Jaccard 0.8 on five-word shingles.
    group = reach(shingle_sets := {d: shingles(r["text"]) for d, r in inputs[2].items()},
                  lambda a, b: similar(shingle_sets[a], shingle_sets[b]))
    assert sorted(r["doc_id"] for r in outputs[2]) == sorted(set(group.values()))

    # Mixing: a source's words reach its target, by less than one document more.
    size = lambda t: len((t or "").split())
    sizes = collections.Counter()
    for r in inputs[3].values():
        sizes[r["source"]] += size(r["text"])
    taken, most = collections.Counter(), collections.Counter()
    for r in outputs[3]:
        taken[r["source"]] += size(r["text"])
        most[r["source"]] = max(most[r["source"]], size(r["text"]))
        assert r == inputs[3][r["doc_id"]]
    assert max(collections.Counter(r["doc_id"] for r in outputs[3]).values()) <= 3
    for source, target in slow_targets(sizes).items():
        assert int(target) <= taken[source] < target + most[source] + 1

    # Segmentation: distinct samples that decode to the text.
    vocabulary = gumbel.Decoder(gumbel.Vocabulary.load())
    for r in outputs[4]:
        assert vocabulary.decode(r["ids"]) == (inputs[4][r["doc_id"]]["text"] or "")
        assert r["sample"] == "mine" and r["sample_1"] in (1, 2)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF_DIR)
    assert got.count() > 0
    assert {"doc_id", "source", "sample", "ids"} <= set(got.columns)


def test_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, SF_DIR)
            assert out.columns == docs.columns
            out.collect()
