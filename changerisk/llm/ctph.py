"""Context-triggered piecewise hashes of whole texts.

A rolling hash over eight bytes decides where chunks end, so an edit moves only
the chunks around it. A fingerprint spells one character per chunk at two
neighbouring block sizes; fingerprints with a block size in common are compared
by edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changerisk.llm.scratch import written

#: Bytes that decide on a boundary.
WINDOW = 8
#: Bits that a boundary has at the smallest block size: blocks of 4 bytes on average.
LEAST_BITS = 2
#: Characters of a signature at most; the block size doubles until they suffice.
LENGTH = 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_ROLL = 0x9E3779B1
_STEP = 0x9E3779B97F4A7C15
_STEP_BACK = pow(_STEP, -1, 1 << 64)
#: Bytes hashed at once.
BLOCK = 1 << 21


@cache
def _powers(base: int, log: int) -> np.ndarray:
    """The first ``2**log`` powers of an odd number, modulo 2**64."""
    out = np.ones(1, dtype=np.uint64)
    factor = np.uint64(base)
    while out.size < 1 << log:
        out = np.concatenate([out, out * factor])
        factor = factor * factor
    return out


def powers_for(base: int, count: int) -> np.ndarray:
    """At least ``count`` powers of an odd number, modulo 2**64."""
    return _powers(base, max(10, int(count).bit_length()))


def fingerprints(data: list[bytes]) -> list[tuple[int, str, str]]:
    """(doubling, signature, signature at twice the block size) of every byte string."""
    out: list[tuple[int, str, str]] = []
    group: list[bytes] = []
    total = 0
    for d in data:
        if group and total + len(d) > BLOCK:
            out += _fingerprints(group)
            group, total = [], 0
        group.append(d)
        total += len(d) + WINDOW
    return out + _fingerprints(group) if group else out


def _fingerprints(data: list[bytes]) -> list[tuple[int, str, str]]:
    gap = bytes(WINDOW)
    flat = np.frombuffer(gap + gap.join(data) + gap, np.uint8)
    ends = np.cumsum([len(d) + WINDOW for d in data])
    with np.errstate(over="ignore"):
        # Sum of the last eight bytes plus one, each times a power of _ROLL.
        roll = flat.astype(np.uint32) + np.uint32(1)
        factor = _ROLL
        for shift in (1, 2, 4):
            older = np.zeros_like(roll)
            older[shift:] = roll[:-shift]
            roll = roll + older * np.uint32(factor)
            factor = factor * factor & 0xFFFFFFFF
        mixed = (roll ^ (roll >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(13)
        cuts = np.flatnonzero(mixed & np.uint32((1 << LEAST_BITS) - 1) == 0)
        low = mixed[cuts].astype(np.int64) >> LEAST_BITS
        low[low == 0] = 1 << 40
        level = np.log2((low & -low).astype(np.float64)).astype(np.int64)
        sums = np.zeros(flat.size + 1, dtype=np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1))
                  * powers_for(_STEP, flat.size)[:flat.size], out=sums[1:])
        back = powers_for(_STEP_BACK, flat.size)
        out = []
        for d, end in zip(data, ends.tolist(), strict=True):
            start = end - len(d)
            at, to = np.searchsorted(cuts, (start, end))
            mine, levels = cuts[at:to] + 1, level[at:to]
            counts = np.bincount(levels, minlength=1)[::-1].cumsum()[::-1]
            doubling = int((counts >= LENGTH).sum())

            def spell(least: int, mine=mine, levels=levels, start=start, end=end) -> str:
                stops = mine[levels >= least]
                edges = np.concatenate([[start], stops, [end] if not stops.size
                                        or stops[-1] < end else []]).astype(np.int64)
                if edges[-1] == start:
                    return ""
                chunk = (sums[edges[1:]] - sums[edges[:-1]]) * back[edges[:-1]]
                chunk = (chunk ^ (chunk >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                return "".join(map(ALPHABET.__getitem__, (chunk >> np.uint64(58)).tolist()))

            out.append((doubling, spell(doubling), spell(doubling + 1)))
    return out


def spelled(print_: tuple[int, str, str]) -> str:
    """``block size:signature:signature at twice the block size``."""
    return f"{(1 << LEAST_BITS) << print_[0]}:{print_[1]}:{print_[2]}"


def _common(a: tuple[int, str, str], b: tuple[int, str, str]) -> tuple[str, str] | None:
    """Signatures at the largest block size that both have, if any."""
    step = a[0] - b[0]
    return {0: (a[1], b[1]), 1: (a[1], b[2]), -1: (a[2], b[1])}.get(step)


def likeness(pairs: list[tuple[tuple[int, str, str], tuple[int, str, str]]]) -> np.ndarray:
    """1 minus the edit distance over the longer signature; 0 without a common block size.

    Equal fingerprints are 1. All pairs go through one table row by row: the
    cheapest way along a row is a running minimum of cost minus place.
    """
    common = [_common(*p) for p in pairs]
    out = np.array([float(a == b) for a, b in pairs])
    todo = [i for i, c in enumerate(common) if c and pairs[i][0] != pairs[i][1]]
    for at in range(0, len(todo), 4096):
        some = todo[at:at + 4096]
        left, right = ([common[i][k] for i in some] for k in (0, 1))
        n, m = (np.array([len(s) for s in side]) for side in (left, right))
        x, y = (np.frombuffer("".join(s.ljust(LENGTH + 1, " ") for s in side).encode(),
                              np.uint8).reshape(len(some), LENGTH + 1) for side in (left, right))
        place = np.arange(LENGTH + 2, dtype=np.int16)
        row = np.broadcast_to(place, (len(some), LENGTH + 2)).copy()
        final = row[np.arange(len(some)), m].copy()
        for i in range(int(n.max(initial=0))):
            new = row + 1
            np.minimum(new[:, 1:], row[:, :-1] + (x[:, i:i + 1] != y), out=new[:, 1:])
            row = np.minimum.accumulate(new - place, axis=1) + place
            done = n == i + 1
            final[done] = row[done, m[done]]
        out[some] = 1 - final / np.maximum(1, np.maximum(n, m))
    return out


_RESULT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _measured(texts: list[str], heads: list[str], prints: list | None = None) -> list[tuple]:
    """Result rows of texts and their next documents' texts."""
    cut = [len(t) // 4 for t in texts]
    edited = [(t[:len(t) - c] + h[:c]).encode("utf-8", "surrogatepass")
              for t, h, c in zip(texts, heads, cut, strict=True)]
    own = fingerprints([t.encode("utf-8", "surrogatepass") for t in texts])
    after = own[1:] + fingerprints([heads[-1].encode("utf-8", "surrogatepass")]) \
        if prints is None else prints
    changed = fingerprints(edited)
    near_edited = likeness(list(zip(own, changed, strict=True)))
    near_next = likeness(list(zip(own, after, strict=True)))
    return [(len(t), hashlib.sha256(e).hexdigest(), spelled(f), spelled(g), float(a), float(b))
            for t, e, f, g, a, b in zip(texts, edited, own, changed, near_edited, near_next,
                                        strict=True)]


def fingerprint_and_edit(docs: DataFrame, *, key: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, and two likenesses.

    The edited text has its last quarter of code points (rounded down) replaced
    by the first as many of the next document's text. Documents are ordered by
    key, null first; rows with equal keys by a hash of their text. After the
    last comes the first, so a single document follows itself. A null text is
    empty. Returns the key, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``.

    Whole texts move once, into key ranges. Inside a range the next document is
    the next row; only the last row of every range waits for the first row of
    the following one, and these two rows of a range are joined afterwards.
    """
    kind = docs.schema[key].dataType.simpleString()
    ordered = (
        docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("key", "tie").sortWithinPartitions("key", "tie"))
    names = [c.split()[0] for c in _RESULT.split(", ")]
    columns = ["place", "key", "tie", "text", *names]

    def frame(place: str, rows: list[tuple], made: list[tuple]) -> pd.DataFrame:
        whole = place != "done"
        return pd.DataFrame([(place, k, t, text if whole else None, *m)
                             for (k, t, text), m in zip(rows, made, strict=True)],
                            columns=columns).astype({"n_chars": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = (None,) * len(names)
        held: list[tuple] = []
        for batch in batches:
            rows = list(zip(batch["key"], batch["tie"], batch["text"], strict=True))
            for at in range(0, len(rows), 1000):
                part = held + rows[at:at + 1000]
                if not held:
                    yield frame("first", part[:1], [nothing])
                held = part[-1:]
                if len(part) > 1:
                    texts = [r[2] for r in part]
                    yield frame("done", part[:-1], _measured(texts[:-1], texts[1:]))
        if held:
            yield frame("last", held, [nothing])

    schema = f"place string, key {kind}, tie long, text string, {_RESULT}"
    parts = written(ordered.mapInPandas(run, schema))
    ends = parts.where("place <> 'done'").select("place", "key", "tie", "text")
    firsts = ends.where("place = 'first'")
    # One row per range: which range follows which.
    follow = Window.partitionBy().orderBy("key", "tie", "place")
    everything = Window.partitionBy()
    linked = (
        ends.select("place", "key", "tie")
        .withColumn("next", F.lead(F.struct("key", "tie")).over(follow))
        .withColumn("start", F.min(F.struct("key", "tie")).over(everything))
        .where("place = 'last'")
        .select("key", "tie", F.coalesce("next", "start").alias("next")))
    waiting = (
        ends.where("place = 'last'").alias("a")
        .join(linked.alias("l"), F.col("a.key").eqNullSafe(F.col("l.key"))
              & (F.col("a.tie") == F.col("l.tie")))
        .join(firsts.alias("f"), F.col("l.next.key").eqNullSafe(F.col("f.key"))
              & (F.col("l.next.tie") == F.col("f.tie")))
        .select("a.key", "a.text", F.col("f.text").alias("head")))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_measured([t], [h])[0]
                    for t, h in zip(batch["text"], batch["head"], strict=True)]
            yield batch[["key"]].reset_index(drop=True).join(pd.DataFrame(rows, columns=names))

    last = waiting.mapInPandas(finish, f"key {kind}, {_RESULT}")
    done = parts.where("place = 'done'").select("key", *names)
    return done.unionByName(last).withColumnRenamed("key", key)
