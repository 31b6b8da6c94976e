"""Hard negatives by exact inner products, with length buckets and coordinate pruning.

Rows lie in buckets of nearly equal length, longest first. For an anchor and a
bucket, the least score that still matters gives a local threshold on the cosine;
it bounds the values that a row's coordinate can have where the anchor's own are
largest (its focus coordinates). Sorted lists of the bucket's coordinates turn
these bounds into ranges, whose intersection are the candidates that are scored
exactly (Teflioudi et al., 2015). Where the ranges hold most of a bucket, it is
scored as a whole, which is then the cheaper way to the same rows.

Anchors go in rounds of bounded size, which every task holds; rows never move
once they lie in buckets. A task carries its best rows of every anchor from
bucket to bucket, so later buckets are pruned harder, and only these leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changerisk.llm.scratch import Scratch

#: Rows of a bucket at most.
BUCKET = 4096
#: Anchors of a round, about.
ROUND = 16_384
#: Anchors scored together.
TOGETHER = 512
#: Coordinates whose ranges are intersected.
FOCUS = 3
#: Share of a bucket in the narrowest range beyond which the bucket is scored whole.
WHOLE = 0.25
#: Components are multiplied by this and rounded down.
SCALE = 256
_LEAST = np.iinfo(np.int64).min


def whole_vectors(rows: DataFrame, *, key: str, vector: str, label: Column,
                  scale: int = SCALE) -> DataFrame:
    """``(id, label, x)`` with whole-numbered components.

    Rows with a null id, label or vector, or with a component that is null or
    not finite, take no part. Of rows with one id the least counts.
    """
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    made = rows.select(F.col(f"`{key}`").cast("long").alias("id"), label.cast("long").alias("label"),
                       F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return (made.where("id is not null and label is not null and v is not null").where(fine)
            .select("id", F.struct("label", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))
                    .alias("row"))
            .groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.x"))


class Vectors:
    """Rows as arrays; vectors that are shorter than others end in zeros."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.lengths = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        self._unit = None
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, ids, labels, lists) -> Vectors:
        width = max((len(v) for v in lists), default=0)
        x = np.zeros((len(lists), width), dtype=np.int64)
        for i, v in enumerate(lists):
            x[i, :len(v)] = v
        return cls(np.asarray(ids, dtype=np.int64), np.asarray(labels, dtype=np.int64), x)

    def part(self, at) -> Vectors:
        return Vectors(self.ids[at], self.labels[at], self.x[at])

    def widened(self, width: int) -> Vectors:
        if self.x.shape[1] >= width:
            return self
        return Vectors(self.ids, self.labels, np.pad(self.x, ((0, 0), (0, width - self.x.shape[1]))))

    def unit(self) -> np.ndarray:
        """Vectors of length 1, null vectors as they are."""
        if self._unit is None:
            self._unit = self.x / np.maximum(self.lengths, 1e-300)[:, None]
        return self._unit

    def sorted_list(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        """The values of one coordinate in ascending order, and their rows."""
        if coordinate not in self._sorted:
            order = np.argsort(self.unit()[:, coordinate], kind="stable")
            self._sorted[coordinate] = (self.unit()[order, coordinate], order)
        return self._sorted[coordinate]


def products(a: Vectors, b: Vectors) -> np.ndarray:
    """Exact inner products as whole numbers; beyond 64 bits they stay at the bound."""
    most = [int(np.abs(v.x).max(initial=0)) for v in (a, b)]
    reach = most[0] * most[1] * max(1, a.x.shape[1])
    if reach < 1 << 53:
        return (a.x.astype(np.float64) @ b.x.astype(np.float64).T).astype(np.int64)
    if reach < 1 << 63:
        return a.x @ b.x.T
    exact = a.x.astype(object) @ b.x.astype(object).T
    return np.clip(exact, -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64)


def candidates(anchors: Vectors, bucket: Vectors, least: np.ndarray, focus: int = FOCUS,
               whole: float = WHOLE) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Anchors that need the whole bucket, and ``(anchor, rows)`` of those that need some of it.

    ``least``: the least score that matters to an anchor. Every row that reaches
    it is among the rows given; anchors whose length times the bucket's longest
    cannot reach it are in neither.
    """
    longest = bucket.lengths.max(initial=0.0)
    reach = anchors.lengths * longest
    wanted = least.astype(np.float64)
    # Rounding of lengths and cosines is far below this margin.
    margin = 1e-9
    live = (wanted <= reach * (1 + margin))
    cosine = np.where(reach > 0, wanted / np.maximum(reach, 1e-300), 0.0) - margin
    prunable = live & (cosine > 0)
    everything = np.flatnonzero(live & ~prunable)
    at = np.flatnonzero(prunable)
    if not at.size or not bucket.ids.size:
        return everything, []
    unit, theta = anchors.unit()[at], np.minimum(cosine[at], 1.0)
    focus = min(focus, unit.shape[1])
    chosen = np.argpartition(-np.abs(unit), focus - 1, axis=1)[:, :focus]
    q = np.take_along_axis(unit, chosen, axis=1)
    spread = np.sqrt((1 - theta**2)[:, None] * np.maximum(0.0, 1 - q * q))
    low, high = q * theta[:, None] - spread - margin, q * theta[:, None] + spread + margin
    # Angles within arccos(theta) of the anchor's own; past an axis all values to its end.
    high = np.where(q >= theta[:, None], 1.0 + margin, high)
    low = np.where(q <= -theta[:, None], -1.0 - margin, low)
    first = np.zeros(chosen.shape, dtype=np.int64)
    last = np.zeros(chosen.shape, dtype=np.int64)
    for c in np.unique(chosen):
        values, _ = bucket.sorted_list(int(c))
        here = chosen == c
        first[here] = np.searchsorted(values, low[here], side="left")
        last[here] = np.searchsorted(values, high[here], side="right")
    size = last - first
    narrow = size.argmin(axis=1)
    share = size.min(axis=1) / bucket.ids.size
    some = []
    for k in np.flatnonzero(share <= whole):
        order = bucket.sorted_list(int(chosen[k, narrow[k]]))[1]
        rows = order[first[k, narrow[k]]:last[k, narrow[k]]]
        for f in range(focus):
            if f != narrow[k] and rows.size:
                values = bucket.unit()[rows, chosen[k, f]]
                rows = rows[(values >= low[k, f]) & (values <= high[k, f])]
        if rows.size:
            some.append((int(at[k]), rows))
    return np.sort(np.concatenate([everything, at[share > whole]])), some


@dataclass
class Best:
    """The first ``size`` rows of every slot: by score, then by id."""

    size: int
    scores: np.ndarray
    ids: np.ndarray

    @classmethod
    def empty(cls, slots: int, size: int) -> Best:
        return cls(size, np.full((slots, size), _LEAST), np.full((slots, size), _LEAST))

    def worst(self) -> np.ndarray:
        """The score that a row must reach to enter a slot."""
        return self.scores[:, -1]

    def add(self, slot: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """New rows, none of which is there yet."""
        if not slot.size:
            return
        touched = np.unique(slot)
        held = self.scores[touched] > _LEAST
        all_slots = np.concatenate([np.repeat(touched, held.sum(axis=1)), slot])
        all_scores = np.concatenate([self.scores[touched][held], scores])
        all_ids = np.concatenate([self.ids[touched][held], ids])
        order = np.lexsort((all_ids, -all_scores, all_slots))
        all_slots, all_scores, all_ids = all_slots[order], all_scores[order], all_ids[order]
        starts = np.searchsorted(all_slots, touched)
        place = np.arange(all_slots.size) - starts[np.searchsorted(touched, all_slots)]
        kept = place < self.size
        self.scores[touched], self.ids[touched] = _LEAST, _LEAST
        self.scores[all_slots[kept], place[kept]] = all_scores[kept]
        self.ids[all_slots[kept], place[kept]] = all_ids[kept]


class Search:
    """One round: anchors with slots, each for rows in a band of scores.

    ``slot_anchor`` names the anchor of every slot, ``low`` and ``high`` its band.
    ``same`` asks for rows of the anchor's label other than itself, else for rows
    of other labels. Slots of one anchor stand together.
    """

    def __init__(self, anchors: Vectors, slot_anchor: np.ndarray, low: np.ndarray,
                 high: np.ndarray, size: int, same: bool):
        self.anchors, self.low, self.high, self.same = anchors, low, high, same
        self.slot_anchor = slot_anchor
        self.begin = np.searchsorted(slot_anchor, np.arange(anchors.ids.size + 1))
        self.size = size
        self._parts: dict[int, Vectors] = {}

    def start(self) -> Best:
        return Best.empty(self.low.size, self.size)

    def scan(self, bucket: Vectors, best: Best) -> None:
        """Adds what a bucket has."""
        width = max(bucket.x.shape[1], self.anchors.x.shape[1])
        bucket = bucket.widened(width)
        for i in range(0, self.anchors.ids.size, TOGETHER):
            j = min(i + TOGETHER, self.anchors.ids.size)
            slots = slice(self.begin[i], self.begin[j])
            if slots.start == slots.stop:
                continue
            need = np.maximum(self.low[slots], best.worst()[slots])
            open_ = need <= self.high[slots]
            least = np.full(j - i, np.iinfo(np.int64).max)
            np.minimum.at(least, self.slot_anchor[slots][open_] - i, need[open_])
            if i not in self._parts or self._parts[i].x.shape[1] < width:
                self._parts[i] = self.anchors.part(slice(i, j)).widened(width)
            part = self._parts[i]
            wanted = np.flatnonzero(least < np.iinfo(np.int64).max)
            dense, some = candidates(part.part(wanted), bucket, least[wanted])
            if dense.size:
                at = wanted[dense]
                self._enter(i + at, products(part.part(at), bucket), bucket, best)
            for k, rows in some:
                at, few = wanted[k], bucket.part(rows)
                self._enter(np.array([i + at]), products(part.part([at]), few), few, best)

    def _enter(self, anchors: np.ndarray, scores: np.ndarray, rows: Vectors, best: Best) -> None:
        """Rows whose scores lie in an open band of a slot."""
        alike = self.anchors.labels[anchors][:, None] == rows.labels[None, :]
        if self.same:
            fits = alike & (self.anchors.ids[anchors][:, None] != rows.ids[None, :])
        else:
            fits = ~alike
        most = int((self.begin[anchors + 1] - self.begin[anchors]).max(initial=0))
        for n in range(most):
            has = np.flatnonzero(self.begin[anchors] + n < self.begin[anchors + 1])
            slot = self.begin[anchors[has]] + n
            need = np.maximum(self.low[slot], best.worst()[slot])
            s = scores[has]
            a, r = np.nonzero(fits[has] & (s >= need[:, None]) & (s <= self.high[slot][:, None]))
            best.add(slot[a], s[a, r], rows.ids[r])


class Buckets:
    """Rows of ``vectors(id, label, x)``, longest first, written once.

    Files hold rows in this order, so a run of rows that a task reads is a
    bucket: its lengths lie close together, and its longest row is known.
    """

    def __init__(self, vectors: DataFrame, scratch: Scratch, size: int = BUCKET):
        length = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
        self.size = size
        self.table, _ = scratch.keep(
            vectors.withColumn("length", length)
            .repartitionByRange(F.col("length").desc(), F.col("id"))
            .sortWithinPartitions(F.col("length").desc(), "id").select("id", "label", "x"))

    def search(self, search: Search) -> DataFrame:
        """``(slot, score, id)``: of every slot the first rows of each task's buckets."""
        sent = self.table.sparkSession.sparkContext.broadcast(search)
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = sent.value
            best = s.start()
            for batch in batches:
                for i in range(0, batch.num_rows, size):
                    s.scan(unpacked(*batch.slice(i, size).columns), best)
            slot, place = np.nonzero(best.scores > _LEAST)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(best.scores[slot, place]), pa.array(best.ids[slot, place])],
                names=["slot", "score", "id"])

        return self.table.mapInArrow(run, "slot long, score long, id long")


def unpacked(ids: pa.Array, labels: pa.Array, xs: pa.ListArray) -> Vectors:
    """A bucket's columns as arrays, without a Python object per component."""
    n = xs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = xs.flatten().to_numpy(zero_copy_only=False)
    width = int(n.max(initial=0))
    if (n == width).all():
        x = flat.reshape(n.size, width)
    else:
        x = np.zeros((n.size, width), dtype=np.int64)
        at = np.arange(flat.size) - np.repeat(np.cumsum(n) - n, n)
        x[np.repeat(np.arange(n.size), n), at] = flat
    return Vectors(ids.to_numpy(zero_copy_only=False), labels.to_numpy(zero_copy_only=False), x)


def _first(found: DataFrame, size: int) -> DataFrame:
    """The first ``size`` rows of every slot, with their rank."""
    order = Window.partitionBy("slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def mine(vectors: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 10,
         low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100),
         round_size: int = ROUND, bucket: int = BUCKET) -> DataFrame:
    """Negatives of every anchor and positive of ``vectors(id, label, x)``.

    ``vectors`` is the result of ``whole_vectors``, ``is_anchor`` a condition on
    its ``id``. A score is an inner product; higher ones come first, ties by
    smaller id. An anchor's positives are its first ``positives`` other rows of
    its label; a positive's negatives the first ``negatives`` rows of other
    labels with a score from ``low`` to ``high`` times the positive's, bounds
    included. Returns ``(anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score)``; an anchor without positives, or a
    positive without such a row (as all with a score under 0), has none. An
    empty table gives an empty one. Scores beyond 64 bits count as the bound.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows, rows_path = scratch.keep(vectors.select("id", "label", "x"))
    buckets = Buckets(rows, scratch, bucket)
    picked, picked_path = scratch.keep(rows.where(is_anchor))
    rounds = max(1, -(-picked.count() // round_size))
    scratch.drop(rows_path)
    out = []
    for k in range(rounds):
        mine_ = (picked.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == k)
                 .orderBy("id").collect())
        anchors = Vectors.of([r["id"] for r in mine_], [r["label"] for r in mine_],
                             [r["x"] for r in mine_])
        every = np.arange(anchors.ids.size)
        bounds = np.full(every.size, _LEAST + 1), np.full(every.size, np.iinfo(np.int64).max)
        near, near_path = scratch.keep(_first(buckets.search(
            Search(anchors, every, *bounds, positives, True)), positives))
        held = sorted((r["slot"], r["rank"], r["id"], r["score"]) for r in near.collect())
        scratch.drop(near_path)
        score = np.array([h[3] for h in held], dtype=object)
        bands = (np.array([-(-low[0] * s // low[1]) for s in score], dtype=np.int64),
                 np.array([high[0] * s // high[1] for s in score], dtype=np.int64))
        slot_anchor = np.array([h[0] for h in held], dtype=np.int64)
        found, path = scratch.keep(_first(buckets.search(
            Search(anchors, slot_anchor, *bands, negatives, False)), negatives))
        named = spark.createDataFrame(
            [(i, int(anchors.ids[h[0]]), h[2], h[3]) for i, h in enumerate(held)],
            "slot long, anchor_id long, positive_id long, positive_score long")
        # A round's slots are bounded, and so is their table.
        done, _ = scratch.keep(found.join(F.broadcast(named), "slot").select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score")))
        scratch.drop(path)
        out.append(done)
    scratch.drop(picked_path)
    first, *rest = out
    for df in rest:
        first = first.unionByName(df)
    return first
