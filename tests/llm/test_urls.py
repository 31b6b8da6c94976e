from __future__ import annotations

from pyspark.sql import functions as F

from changerisk.llm import urlfilter
from changerisk.llm.urlfilter import Rule

RULES = [Rule(True, "bad.org"), Rule(False, "bad.org", "/good/"), Rule(True, "com", "/en/"),
         Rule(False, "example.com", "/en/7")]


def verdicts(spark, rows, **more):
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    return {r["page_id"]: (r["rule"], r["verdict"]) for r in
            urlfilter.filter_urls(pages, RULES, keep=["page_id"], **more).collect()}


def test_rules(spark):
    got = verdicts(spark, [
        (1, "http://a.bad.org/x", None), (2, "http://notbad.org/x", None),
        (3, "HTTPS://BAD.org/good/1?x#y", ""), (4, None, None), (5, "no scheme", None),
        (6, "http://www.example.com/en/77", None), (7, "http://www.example.com/en/8", None),
        (8, "x://bad.org", None), (9, "x://a?b://bad.org/", None)])
    assert got == {1: ("bad.org/", "block"), 2: (None, "allow"), 3: ("bad.org/good/", "allow"),
                   4: (None, "allow"), 5: (None, "allow"), 6: ("example.com/en/7", "allow"),
                   7: ("com/en/", "block"), 8: (None, "allow"), 9: (None, "allow")}


def test_aliases(spark):
    link = '<html><link href="{}" rel=canonical><meta charset=x></html>'
    got = verdicts(spark, [
        (1, "http://one.net/a?utm_source=x", link.format("http://two.net/b/")),
        (2, "https://two.net/b#top", '<META content="0; URL=http://bad.org/x" http-equiv=Refresh>'),
        (3, "http://three.net/c", link.format("https://two.net/b")),
        (4, "http://four.net/", link.format("//four.net/other")),
        (5, "http://five.net/", link.format("http://bad.org/good/x")),
        (6, "http://five.net/z", link.format("http://five.net/")),
        (7, "http://bad.org/y", link.format("http://five.net/z")),
        (8, "http://four.net/other", '<link rel="stylesheet" href="http://bad.org/x">')])
    assert {k: v for k, (_, v) in got.items()} == {
        1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block",
        8: "allow"}


def test_chain_of_redirects(spark):
    rows = [(i, f"http://h{i}.net/", f'<link rel="canonical" href="http://h{i + 1}.net/">')
            for i in range(60)] + [(60, "http://h60.net/",
                                    "<meta http-equiv='refresh' content='1;url=http://bad.org/'>")]
    assert {v for _, v in verdicts(spark, rows).values()} == {"block"}


def test_odd_tables(spark):
    pages = spark.createDataFrame([(1, None, None, "h"), (1, None, None, "h")],
                                  "page_id int, url string, html string, host string")
    got = urlfilter.filter_urls(pages, RULES)
    assert got.columns == ["page_id", "url", "html", "host", "host_1", "path", "rule", "verdict"]
    assert [r["host_1"] for r in got.collect()] == ["", ""]
    assert urlfilter.filter_urls(pages.where(F.lit(False)), RULES).count() == 0


def test_relative_targets(spark):
    own = "http://a.org/x/de/7.html?q=1"
    want = {"8.html": "a.org/x/de/8.html", "../de/8": "a.org/x/de/8", "./9": "a.org/x/de/9",
            "../../../up/./z?k=../v": "a.org/up/z?k=../v", "?p=2": "a.org/x/de/7.html?p=2",
            "/r": "a.org/r", "//b.org/c": "b.org/c", "mailto:x@y.z": None, "#top": None}
    for target, node in want.items():
        html = f'<link rel="canonical" href="{target}">'
        pages = spark.createDataFrame([(own, html), ("http://a.org", "<p>canonical")],
                                      "url string, html string")
        got = [(r["a"], r["b"]) for r in urlfilter.page_links(pages).collect()]
        assert got == ([] if node is None else [("a.org/x/de/7.html?q=1", node)]), target
    root = spark.createDataFrame(
        [("http://a.org", '<meta http-equiv=refresh content="0;url=n.html">')],
        "url string, html string")
    assert [r["b"] for r in urlfilter.page_links(root).collect()] == ["a.org/n.html"]
