from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from changerisk.llm import toxicity
from changerisk.llm.columns import held_out
from changerisk.llm.toxicity import INSULT, NEGATION, REPORT, TARGET, THREAT, WORD

SF = "/root/testdata/sf0.1"
G = toxicity.Grammar({"=fool": 2.0, "idio": 3.0}, intercept=-2.0, slope=2.0)


def test_machines_and_their_product():
    tags = [NEGATION, WORD, INSULT, REPORT, WORD, INSULT, WORD, INSULT]
    assert toxicity.negation().run(tags) == [1, 1, 0.5, 1, 1, 1, 1, 1]
    assert toxicity.reported().run(tags) == [1, 1, 1, 1, 1, 0.7, 1, 0.7]
    both = toxicity.negation().compose(toxicity.reported())
    assert both.run(tags) == pytest.approx([a * b for a, b in zip(
        toxicity.negation().run(tags), toxicity.reported().run(tags), strict=True)])
    assert toxicity.targeted().run([THREAT, TARGET, INSULT, THREAT]) == [0, 1, 1.25, 1]


def test_clauses():
    weight = lambda t: pytest.approx(G.weight(t))
    assert weight("He is fine. What a fool") == 2.0
    assert weight("you fool") == weight("fool, you") == 2.5
    assert weight("You IDIOTS!") == 3.75
    assert weight("foolish or video") == 0  # not the word, not at its start
    assert weight("not a fool") == 1.0
    assert weight("she said fool") == 2 * 0.7 * 1.25
    assert weight("not you. fool") == 2.0  # another clause
    assert weight("they kill time") == 5 * 0 + G.weight("they kill time")
    assert G.weight("we kill time") == 0
    assert G.weight("I will kill you") > 0
    assert [c for c, _ in G.clauses("Fine here. You fool; bye")] == ["you fool"]
    assert G.clauses(None) == G.clauses("") == []
    assert G.score(0) < 0.5 < G.score(10)


def test_lexicon_prefers_the_purest_stem():
    found = toxicity.lexicon({"lose": 100, "loser": 95, "=loser": 95, "=the": 100, "idio": 80,
                              "idiot": 80}, {"lose": 60, "=the": 900}, 100, 900)
    assert set(found) == {"loser", "idio"}


def test_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    grammar = toxicity.train(docs, labels, held_out(F.col("doc_id")))
    got = (toxicity.score(docs.select("doc_id", "text"), grammar).join(labels, "doc_id")
           .where(held_out(F.col("doc_id"))).groupBy("toxic", "predicted").count().collect())
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.85
    assert n.get((0, 1), 0) / n[0, 0] < 0.01


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("score", F.lit("mine"))
    got = toxicity.score(docs, G)
    assert got.columns[-4:] == ["score_1", "predicted", "weight", "clauses"]
    assert got.count() == odd_docs.count()
    bad = docs.unionByName(spark.createDataFrame(
        [(99, "you fool, you idiot", "en", "a", 1, "mine")], docs.schema))
    kept = toxicity.reject(bad, G)
    assert kept.columns == bad.columns
    assert kept.count() == odd_docs.count() and kept.where("doc_id = 99").count() == 0
    assert toxicity.reject(no_docs, G).count() == 0
    labels = spark.createDataFrame([(1, 0, 1), (None, 0, 1), (3, 1, None)],
                                   "doc_id long, quality int, toxic int")
    for sample in (labels, labels.where("false")):
        g = toxicity.train(odd_docs, sample, F.lit(False))
        assert g.lexicon == {} and 0 <= g.score(0) <= 1


@pytest.mark.parametrize("text", ["espèce d'idiot", "l’idiote, là"])
def test_match_after_an_elision(text):
    assert G.weight(text) == 3.0
    assert G.score(G.weight(text)) > 0.5
    assert G.weight("d'or") == 0
