"""Quality by a logistic regression over hashed word n-grams.

The words of a text, and their shapes (case, length, kind of sign, repetition of
the word before), make n-grams that are hashed to a fixed number of weights. The
regression is trained by follow-the-regularised-leader updates (McMahan et al.,
2013): every weight is read off the sum of its gradients, so most stay exactly
zero. A text's score is a sparse dot product under a logistic curve.

Shards of the sample are trained apart, each in one task, and their sums are
averaged after every pass (iterative parameter mixing); the next pass starts
from the average.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.llm.columns import own_name
from changerisk.llm.scratch import Scratch

#: Labelled texts to learn from at most, those with the smallest hashes of their ids.
MAX_LABELLED = 50_000
#: Labelled texts of a shard, about.
SHARD = 2048
#: Weights are 2 to this power.
BITS = 18
#: Parts of one in which sums of shards are added up.
UNIT = 1 << 40
#: Longest n-grams of words and of shapes.
WORDS, SHAPES = 2, 3
#: From this score a text counts as good.
THRESHOLD = 0.3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TOKEN = re.compile(r"[^\W\d_]+|\d+|\S")
#: Words whose hashes a task remembers.
_REMEMBERED = 1 << 18


def shape(word: str) -> str:
    """Kind of a word: case and length of letters, digits, or the sign itself."""
    if word[0].isalpha():
        case = "A" if word.isupper() else "T" if word[0].isupper() else "a"
        return f"{case}{min(len(word), 9) // 3}"
    return "9" if word[0].isdigit() else word


class Features:
    """Hashed n-grams of texts: ``(places, values)``, values of length 1 together."""

    def __init__(self, bits: int = BITS, words: int = WORDS, shapes: int = SHAPES):
        self.bits, self.words, self.shapes = bits, words, shapes
        self._known: dict[str, tuple[int, int]] = {}
        self._again = xxhash.xxh64_intdigest("\x02again")

    def _hashes(self, word: str) -> tuple[int, int]:
        pair = (xxhash.xxh64_intdigest(word.lower()), xxhash.xxh64_intdigest("\x01" + shape(word)))
        if len(self._known) >= _REMEMBERED:
            self._known.clear()
        self._known[word] = pair
        return pair

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places in ascending order and their values; none without a word or sign."""
        found = _TOKEN.findall(text or "")
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        known = self._known
        both = np.array([known.get(w) or self._hashes(w) for w in found], dtype=np.uint64)
        word, kind = both[:, 0], both[:, 1].copy()
        kind[1:][word[1:] == word[:-1]] = self._again
        parts = []
        for hashes, longest in ((word, self.words), (kind, self.shapes)):
            made = hashes
            for n in range(1, min(longest, hashes.size) + 1):
                if n > 1:
                    made = made[:-1] * _MIX + hashes[n - 1:]
                parts.append(made)
        places = (np.concatenate(parts) * _MIX) >> np.uint64(64 - self.bits)
        at, n = np.unique(places.astype(np.int64), return_counts=True)
        values = 1 + np.log(n)
        return at, values / np.sqrt(values @ values)


@dataclass
class Ftrl:
    """Sums of follow-the-regularised-leader: ``z`` and ``n``, the intercept in the last place."""

    z: np.ndarray
    n: np.ndarray
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.2
    l2: float = 1.0

    @classmethod
    def empty(cls, size: int) -> Ftrl:
        return cls(np.zeros(size + 1), np.zeros(size + 1))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / (
            (self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def intercept(self) -> float:
        """The intercept is not held back."""
        return float(-self.z[-1] * self.alpha / (self.beta + math.sqrt(self.n[-1])))

    def update(self, at: np.ndarray, values: np.ndarray, y: float) -> None:
        """One labelled text."""
        w, b = self.weights(at), self.intercept()
        error = logistic(float(w @ values) + b) - y
        g = error * values
        squares = g * g
        self.z[at] += g - (np.sqrt(self.n[at] + squares) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += squares
        grown = self.n[-1] + error * error
        self.z[-1] += error - (math.sqrt(grown) - math.sqrt(self.n[-1])) / self.alpha * b
        self.n[-1] = grown


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


@dataclass
class Model:
    """Weights that are not zero, and how texts become features."""

    places: np.ndarray
    weights: np.ndarray
    intercept: float
    features: Features

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.features.bits)
        w[self.places] = self.weights
        return w

    def __getstate__(self):
        f = self.features
        return self.__dict__ | {"features": Features(f.bits, f.words, f.shapes)}


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``(doc_id, text, y)`` of at most ``most`` labelled documents, those with the smallest id hashes.

    ``labels(doc_id, quality)``; null ids, labels and texts are left out, and an
    id with several labels is good if one says so. Only the chosen ids are
    broadcast, ``most`` at the utmost.
    """
    chosen = (labels.where("doc_id is not null and quality is not null")
              .groupBy("doc_id").agg(F.max("quality").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    return (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .where("text is not null").select("doc_id", "text", (F.col("y") > 0).cast("int").alias("y")))


def _pack(group: pa.Table) -> pa.Table:
    """A shard as one row of arrays, so that no pass has to deal it out again."""
    at, v = (group.column(c).combine_chunks() for c in ("at", "v"))
    cuts = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False))])
    made = {"key": group.column("key").to_numpy().astype("<i8"),
            "y": group.column("y").to_numpy().astype("<i8"), "cuts": cuts.astype("<i8"),
            "at": at.flatten().to_numpy().astype("<i4", copy=False),
            "v": v.flatten().to_numpy().astype("<f4", copy=False)}
    return pa.table({c: pa.array([x.tobytes()], pa.binary()) for c, x in made.items()})


def order_of(key: np.ndarray, turn: int) -> np.ndarray:
    """Order in which a pass goes through texts; ``key`` are hashes of their ids."""
    return np.argsort((key ^ np.uint64(turn)) * _MIX, kind="stable")


def whole(x: np.ndarray) -> np.ndarray:
    """Numbers as multiples of ``1 / UNIT``: their sums are the same in any order."""
    return np.rint(x * UNIT).astype(np.int64)


def _one_pass(packed: DataFrame, state: Ftrl, turn: int, shards: int) -> Ftrl:
    """The average of the sums that every one of ``shards`` reaches from ``state``."""
    sent = packed.sparkSession.sparkContext.broadcast(state)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                key, y, cuts, at, v = (
                    np.frombuffer(batch.column(c)[i].as_buffer(), kind)
                    for c, kind in (("key", "<u8"), ("y", "<i8"), ("cuts", "<i8"), ("at", "<i4"),
                                    ("v", "<f4")))
                own = Ftrl(start.z.copy(), start.n.copy())
                for k in order_of(key, turn):
                    here = slice(cuts[k], cuts[k + 1])
                    own.update(at[here], v[here].astype(np.float64), float(y[k]))
                moved = np.flatnonzero((own.z != start.z) | (own.n != start.n))
                yield pa.RecordBatch.from_pydict({
                    "at": pa.array(moved), "z": pa.array(whole(own.z[moved] - start.z[moved])),
                    "n": pa.array(whole(own.n[moved] - start.n[moved]))})

    moved = packed.mapInArrow(learn, "at long, z long, n long").groupBy("at").agg(
        F.sum("z").alias("z"), F.sum("n").alias("n")).toArrow()
    at = moved.column("at").to_numpy()
    z, n = state.z.copy(), state.n.copy()
    z[at] += moved.column("z").to_numpy() / (UNIT * shards)
    n[at] += moved.column("n").to_numpy() / (UNIT * shards)
    sent.unpersist()
    return Ftrl(z, n)


def train(sample: DataFrame, *, passes: int = 4, shard: int = SHARD, bits: int = BITS) -> Model:
    """A model of ``sample(doc_id, text, y)``, by ``passes`` rounds over its shards.

    The sample is bounded by its maker; a shard has about ``shard`` rows, dealt
    by a hash of their ids, and the driver holds two numbers per weight.
    Without rows every text scores 0.5, with one class only its smoothed share.
    """
    scratch = Scratch(sample.sparkSession)
    features = Features(bits)
    sizes = dict(sample.groupBy("y").count().collect())
    good, bad = sizes.get(1, 0), sizes.get(0, 0)
    if not good or not bad:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0),
                     math.log((good + 0.5) / (bad + 0.5)), features)
    shards = max(1, round((good + bad) / shard))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [features.of(t) for t in batch["text"]]
            keys = [xxhash.xxh64_intdigest(str(d)) for d in batch["doc_id"]]
            yield pd.DataFrame({
                "shard": [k % shards for k in keys],
                "key": np.array(keys, dtype=np.uint64).astype(np.int64), "y": batch["y"],
                "at": [m[0].astype("int32") for m in made],
                "v": [m[1].astype("float32") for m in made]})

    packed, path = scratch.keep(
        sample.select("doc_id", "text", "y")
        .mapInPandas(hashed, "shard long, key long, y int, at array<int>, v array<float>")
        .groupBy("shard")
        .applyInArrow(_pack, "key binary, y binary, cuts binary, at binary, v binary"))
    packed_shards = packed.select("key").count()
    state = Ftrl.empty(1 << bits)
    for turn in range(passes):
        state = _one_pass(packed, state, turn, packed_shards)
    scratch.drop(path)
    weights = state.weights(slice(0, -1))
    places = np.flatnonzero(weights)
    return Model(places, weights[places], state.intercept(), features)


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None,
          threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``) to ``keep``.

    ``keep`` are all columns but the text if not given; if it has such a name,
    the new column gets ``_1``. Null and empty texts have no feature and get the
    score of the intercept. Whole texts are read, rows are independent, and an
    empty table gives an empty one.
    """
    keep = keep if keep is not None else [c for c in docs.columns if c != text]
    names = [own_name(keep, "score")]
    names.append(own_name(keep + names, "predicted"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
                         F.col(f"`{text}`").alias("text"))
    kept = "".join(f"k{i} {f.dataType.simpleString()}, " for i, f in
                   enumerate(chosen.schema.fields[:-1]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        dense = m.dense()
        for batch in batches:
            out = []
            for t in batch.pop("text"):
                at, v = m.features.of(t)
                out.append(logistic(float(dense[at] @ v) + m.intercept))
            batch["score"] = out
            yield batch

    return chosen.mapInPandas(run, f"{kept}score double").select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("score").alias(names[0]),
        (F.col("score") >= threshold).cast("int").alias(names[1]))


def train_and_score(docs: DataFrame, labels: DataFrame, held_out: Column,
                    most: int = MAX_LABELLED) -> DataFrame:
    """A model from the labelled documents not held out, and the score of every document.

    ``held_out`` is a condition on ``doc_id``, which both tables have.
    """
    model = train(labelled(docs, labels.where(~held_out), most))
    return score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
