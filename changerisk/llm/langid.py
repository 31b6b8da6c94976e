"""Language identification by rank-order profiles.

A profile is a language's most frequent letter n-grams in order of frequency.
A document's own order is compared with every profile by the out-of-place
distance (Cavnar and Trenkle, 1994): how far each n-gram stands from its place
in the profile, and the greatest distance where the profile lacks it.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changerisk.llm.columns import own_name

#: N-grams in a profile, and compared of a document.
PROFILE_SIZE = 300
#: Stands for everything between two words.
GAP = 1
#: An n-gram is held as three code points of 21 bits, the last ones 0 if it is shorter.
BITS = 21


@cache
def _kinds() -> np.ndarray:
    """By code point: 2 for a letter, 1 for a mark inside a word, else 0."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        kinds[c] = 2 if kind == "L" else 1 if kind == "M" else 0
    return kinds


def symbols(text: str | None) -> np.ndarray:
    """Lower-case letters with one gap before, between and after words; empty without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _kinds()[codes]
    if not (kinds == 2).any():
        return np.zeros(0, dtype=np.int64)
    out = np.empty(codes.size + 2, dtype=np.int64)
    out[0] = out[-1] = GAP
    out[1:-1] = np.where(kinds > 0, codes, GAP)
    keep = np.ones(out.size, dtype=bool)
    keep[1:] = (out[1:] != GAP) | (out[:-1] != GAP)
    return out[keep]


def ngrams(s: np.ndarray) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams that have a letter and no gap inside."""
    one = s[s != GAP] << (2 * BITS)
    two = (s[:-1] << (2 * BITS)) | (s[1:] << BITS)
    three = ((s[:-2] << (2 * BITS)) | (s[1:-1] << BITS) | s[2:])[s[1:-1] != GAP]
    return np.concatenate([one, two, three])


def count_ngrams(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """How often every n-gram occurs in every language: ``(lang, ngram, n)``.

    Each task counts its own documents first. Rows with a null language or
    without a letter add nothing.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))

        def add(name: str, parts: list[np.ndarray]) -> None:
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            into = counts[name]
            for code, k in zip(codes.tolist(), n.tolist(), strict=True):
                into[code] += k

        for batch in batches:
            held: dict[str, list[np.ndarray]] = defaultdict(list)
            size: dict[str, int] = defaultdict(int)
            for name, t in zip(batch["lang"], batch["text"], strict=True):
                s = symbols(t)
                if s.size:
                    held[name].append(ngrams(s))
                    size[name] += s.size
                    if size[name] > 1_000_000:
                        add(name, held.pop(name))
                        size[name] = 0
            for name, parts in held.items():
                add(name, parts)
        for name, found in counts.items():
            yield pd.DataFrame({"lang": name, "ngram": list(found), "n": list(found.values())})

    texts = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"))
    return (texts.mapInPandas(run, "lang string, ngram long, n long")
            .groupBy("lang", "ngram").agg(F.sum("n").alias("n")))


def profiles(counts: DataFrame, size: int = PROFILE_SIZE) -> DataFrame:
    """The ``size`` most frequent n-grams of every language, from rank 0; ties by code."""
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "ngram")
    return (counts.withColumn("rank", F.row_number().over(order) - 1)
            .where(F.col("rank") < size).select("lang", "ngram", "rank"))


class Profiles:
    """Profiles as arrays: ``size`` rows for each language, so as small as their number."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE_SIZE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.codes = np.array(sorted({r[1] for r in rows}), dtype=np.int64)
        self.ranks = np.full((len(self.langs), self.codes.size), -1, dtype=np.int64)
        place = {name: i for i, name in enumerate(self.langs)}
        for name, code, rank in rows:
            self.ranks[place[name], np.searchsorted(self.codes, code)] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """Nearest language and how much nearer than the second, from 0 to 1."""
        s = symbols(text)
        if not s.size or not self.langs:
            return "und", 0.0
        codes, n = np.unique(ngrams(s), return_counts=True)
        top = codes[np.argsort(-n, kind="stable")[: self.size]]
        at = np.minimum(np.searchsorted(self.codes, top), self.codes.size - 1)
        there = np.where(self.codes[at] == top, self.ranks[:, at], -1)
        out = np.where(there < 0, self.size, np.abs(there - np.arange(top.size))).sum(axis=1)
        order = np.argsort(out, kind="stable")
        best = int(out[order[0]])
        worst = int(out[order[1]]) if order.size > 1 else self.size * top.size
        return self.langs[order[0]], 1 - best / worst if worst else 0.0


def identify(docs: DataFrame, learned: DataFrame, *, text: str = "text",
             keep: list[str] | None = None, size: int = PROFILE_SIZE) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to ``keep`` (all columns but the text if not given).

    If ``keep`` has such a name already, the new column gets ``_1`` after it.

    ``learned`` is the result of ``profiles``; its rows, ``size`` for each
    language, are brought to the driver and sent to every task. A null text, a
    text without a letter, or no profile at all gives ``und`` with score 0.
    """
    found = Profiles([tuple(r) for r in learned.select("lang", "ngram", "rank").collect()], size)
    keep = keep if keep is not None else [c for c in docs.columns if c != text]
    sent = docs.sparkSession.sparkContext.broadcast(found)
    lang_name, score_name = own_name(keep, "lang_pred"), own_name(keep, "score")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [sent.value.predict(t) for t in batch.pop("__text")]
            batch[lang_name] = [m[0] for m in made]
            batch[score_name] = [m[1] for m in made]
            yield batch

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("__text")).mapInPandas(
        run, f"{kept}, `{lang_name}` string, `{score_name}` double")


def train_and_identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """Profiles from the documents not held out, then a prediction for every document."""
    marked = docs.withColumn("held_out", held_out)
    learned = profiles(count_ngrams(marked.where(~F.col("held_out"))))
    return identify(marked, learned, keep=["doc_id", "held_out"])
