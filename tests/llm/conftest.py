from __future__ import annotations

import pytest

from changerisk.llm.shipping import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, one id twice."""
    long_text = " ".join(f"w{i % 97} x{i}" for i in range(30_000))
    rows = [
        (1, "the cat sat on the mat today\nand then it left the house", "en", "a", 5),
        (1, "the cat sat on the mat today\nand then it left the house", "en", "a", 5),
        (1, "another text under the same id", "en", "b", 5),
        (2, None, "en", "a", 0), (3, "", None, None, None), (4, " \n\t ", "fr", "b", 3),
        (5, long_text, "en", "a", len(long_text)), (None, "no id at all here", "en", "a", 1),
        (None, None, None, None, None), (6, "Ünïcödé ▁ 日本語 \U0001f600\nx", "de", "c", 9),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
