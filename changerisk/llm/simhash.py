"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are linked where few bits differ. Their bits are
grouped into partitions, correlated bits together; each partition gets a
threshold of its own, chosen by dynamic programming on estimated candidate
counts. If the thresholds add up to ``distance - partitions + 1``, two linked
fingerprints agree within the threshold in one partition at least (Qin et al.,
2018), so equal keys of a partition give all candidates, which are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.llm.columns import constants, own_name
from changerisk.llm.components import components
from changerisk.llm.linededup import TextJoin, has_word, position
from changerisk.llm.scratch import Scratch, written

BITS = 64
#: Fingerprints under one key that are compared with each other; larger keys are
#: linked through shared neighbours instead, which finds the same links.
PAIRED = 48
_SEED = 42
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority bits of the XXH64 hashes (seed 42) of all ``words``-word shingles.

    A-Z count as a-z; words are parted by space and the control characters 9 to
    13. Fewer words make one shingle, none gives 0. A bit is 1 if it is set in
    over half of the hashes. Signed, as Spark holds it.
    """
    # bytes.lower and bytes.split know exactly these letters and separators.
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*[parts[i:] for i in range(words)], strict=False))
    h = np.array([xxhash.xxh64_intdigest(s, _SEED) for s in shingles], dtype=np.uint64)
    ones = np.empty((8, 8), dtype=np.int64)
    for b in range(8):
        # Byte lanes hold one bit of each byte of the hash.
        ones[b] = ((h >> np.uint64(b)) & _LANES).view(np.uint8).reshape(-1, 8).sum(
            axis=0, dtype=np.int64)
    out = 0
    for byte in range(8):
        for b in range(8):
            if 2 * int(ones[b, byte]) > h.size:
                out |= 1 << (8 * byte + b)
    return out - (1 << 64) if out >> 63 else out


def fingerprints(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None,
                 words: int = 3) -> DataFrame:
    """Adds ``fp`` (``fp_1`` .. if in use) to ``keep`` (all columns but the text if not given)."""
    keep = keep if keep is not None else [c for c in docs.columns if c != text]
    name = own_name(docs.select(*[F.col(f"`{c}`") for c in keep]), "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[name] = [fingerprint(t, words) for t in batch.pop("__text")]
            yield batch

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("__text")).mapInPandas(
        run, f"{kept}, `{name}` long")


def as_hex(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _bit_pairs(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for any two bits, of those that have both.

    Tasks send 64 x 64 counts for each of their batches, which are summed up by
    cell, so the driver gets 64 x 64 numbers at any size.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            raw = batch["fp"].to_numpy(dtype=np.int64).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(batch)
        if n:
            yield pd.DataFrame({"bit": range(BITS), "n": n, "both": total.tolist()})

    rows = (prints.select("fp").mapInPandas(run, "bit int, n long, both array<double>")
            .select("bit", "n", F.posexplode("both").alias("other", "both"))
            .groupBy("bit", "other").agg(F.sum("n").alias("n"), F.sum("both").alias("both"))
            .collect())
    both = np.zeros((BITS, BITS))
    for r in rows:
        both[r["bit"], r["other"]] = r["both"]
    return (int(rows[0]["n"]) if rows else 0), both


def bit_groups(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """``parts`` groups of nearly equal size, each grown by the most correlated free bit."""
    share = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    corr = np.abs(both / max(1, n) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for p in range(parts):
        size = BITS // parts + (p < BITS % parts)
        order = sorted(free)
        first = max(order, key=lambda b: (corr[b, order].sum(), -b))
        group = [first]
        free.remove(first)
        while len(group) < size:
            best = max(sorted(free), key=lambda b: (corr[b, group].mean(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def _probes(size: int, threshold: int) -> int:
    total, ways = 0, 1
    for t in range(threshold + 1):
        total += ways
        ways = ways * (size - t) // (t + 1)
    return total


def allocate(n: int, both: np.ndarray, groups: list[list[int]], distance: int
             ) -> tuple[float, list[int]]:
    """Cheapest thresholds that add up to ``distance - parts + 1``, each -1 or more.

    The cost of threshold t in a partition is its probes, ``n`` times the keys
    within t, plus the candidates: pairs times the chance that two fingerprints
    differ in t of its bits at most, from the share of ones in every bit as if
    bits were independent. Correlated bits agree more often, so the chance is
    raised by what their mean correlation makes of the number of free bits.
    """
    share = np.diag(both) / max(1, n)
    agree = share ** 2 + (1 - share) ** 2
    need = distance - len(groups) + 1
    # best[s]: cheapest cost of the partitions so far with thresholds adding up to s
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        spread = np.sqrt(np.maximum(share[group] * (1 - share[group]), 1e-12))
        cov = both[np.ix_(group, group)] / max(1, n) - np.outer(share[group], share[group])
        corr = np.abs(cov / np.outer(spread, spread))
        free = len(group) / max(1.0, float((corr ** 2).sum(axis=1).mean()))
        chance = np.array([1.0])  # chance of each number of differing bits
        for b in group:
            chance = np.append(chance, 0) * agree[b] + np.append(0, chance) * (1 - agree[b])
        within = np.cumsum(chance) ** (free / len(group))
        found: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, chosen) in best.items():
            for t in range(-1, distance + 1):
                more = 0.0 if t < 0 else n * _probes(len(group), t) + n * n / 2 * within[t]
                if s + t not in found or cost + more < found[s + t][0]:
                    found[s + t] = (cost + more, [*chosen, t])
        best = found
    return best[need]


def layout(n: int, both: np.ndarray, distance: int) -> tuple[list[list[int]], list[int]]:
    """Groups and thresholds of the cheapest number of partitions."""
    plans = []
    for parts in range(2, distance + 3):
        groups = bit_groups(n, both, parts)
        cost, thresholds = allocate(n, both, groups, distance)
        plans.append((cost, groups, thresholds))
    _, groups, thresholds = min(plans, key=lambda p: p[0])
    return groups, thresholds


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _flips(bits: list[int] | range, most: int) -> list[int]:
    """All masks of at most ``most`` of the bits, 0 first."""
    return [_signed(sum(1 << b for b in some))
            for k in range(most + 1) for some in combinations(bits, k)]


def neighbour_links(prints: DataFrame, distance: int = 2, paired: int = PAIRED) -> DataFrame:
    """Edges ``(a, b)`` between ids whose distinct fingerprints differ in ``distance`` bits at most.

    ``prints(id, fp)``, each fingerprint once. Complete as to connection: the
    components over the edges are those over all links. Keys under which more
    than ``paired`` fingerprints lie would make pairs by the square. Their
    fingerprints, and those that probe such a key, are linked through middle
    points instead: two differ in ``distance`` bits or fewer exactly if some
    point is within half of ``distance`` (rounded down) of one and within the
    rest of the other. For an even distance all points within half of it are
    keys; a key has one member for every neighbour of one point, a fixed
    number, and its members are linked to the smallest.
    """
    if distance % 2:
        raise ValueError("the exact way for large keys needs an even distance")
    scratch = Scratch(prints.sparkSession)
    n, both = _bit_pairs(prints)
    groups, thresholds = layout(n, both, distance)

    masks = [_signed(sum(1 << b for b in group)) for group in groups]

    def keys(within: bool) -> DataFrame:
        # Probes as two constant lists: which partition, and which of its bits to flip.
        probes = [(p, flip) for p, (group, t) in enumerate(zip(groups, thresholds, strict=True))
                  if t >= 0 for flip in _flips(group, t if within else 0)]
        each = F.arrays_zip(constants([p for p, _ in probes], "int").alias("part"),
                            constants([flip for _, flip in probes], "long").alias("flip"))
        masked = F.col("fp").bitwiseAND(F.get(constants(masks, "long"), F.col("k.part")))
        return prints.select("id", "fp", F.explode(each).alias("k")).select(
            "id", "fp", "k.part", masked.bitwiseXOR(F.col("k.flip")).alias("value"))

    held = keys(within=False)
    large, _ = scratch.keep(held.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
                            .where(F.col("n") > paired).select("part", "value"))
    small = held.join(large, ["part", "value"], "left_anti")
    asked = keys(within=True).join(large, ["part", "value"], "left_anti") \
        if max(thresholds) > 0 else small
    candidates = (
        small.select("part", "value", F.col("id").alias("a"), F.col("fp").alias("fa"))
        .join(asked.select("part", "value", F.col("id").alias("b"), F.col("fp").alias("fb")),
              ["part", "value"])
        .where((F.col("a") < F.col("b") if max(thresholds) <= 0 else F.col("a") != F.col("b"))
               & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= distance)))
    verified = candidates.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    crowded = (keys(within=True).join(large, ["part", "value"], "left_semi")
               .select("id", "fp").distinct())
    points = crowded.select("id", "fp", F.explode(
        constants(_flips(range(BITS), distance // 2), "long")).alias("flip")).select(
        "id", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    stars = (points.join(points.groupBy("point").agg(F.min("id").alias("b"),
                                                     F.count(F.lit(1)).alias("n"))
                         .where("n > 1").select("point", "b"), "point")
             .where("id <> b").select(F.col("id").alias("a"), "b"))
    return verified.unionByName(stars).distinct()


def _components(prints: DataFrame, distance: int) -> DataFrame:
    """``(fp, component)`` for distinct fingerprints; a component is named by one of its own."""
    ids = prints.select("fp", F.col("fp").alias("id"))
    found = components(neighbour_links(ids, distance)).select(
        F.col("node").alias("fp"), "component")
    return prints.select("fp").join(found, "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                    words: int = 3, distance: int = 2) -> DataFrame:
    """``(key, fp, component_id)``: component_id is the smallest key reachable over links.

    Equal fingerprints are one node from the start, so copies never meet in
    pairs. Null and empty texts have fingerprint 0 and are linked like any
    other; a null key names a component only if all its keys are null. Repeated
    rows give as many rows. An empty table gives an empty one. No other column
    of the input is read.
    """
    rows = written(fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")),
                                words=words))
    prints = written(rows.groupBy("fp").agg(F.min("key").alias("smallest")))
    named = written(prints.join(_components(prints, distance), "fp"))
    smallest = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    of_print = named.join(smallest, "component").select("fp", "component_id")
    return rows.join(of_print, "fp").select(F.col("key").alias(key), "fp", "component_id")


def close_pairs(docs: DataFrame, first: DataFrame, *, words: int, distance: int) -> DataFrame:
    """Candidates ``(line, match)``: texts whose fingerprints differ in ``distance`` bits at most.

    ``docs(key, text)``; ``first`` has the spot ``(key, pos)`` of one text of
    every class of equal words. Texts with one fingerprint are paired with the
    smallest spot among them, fingerprints by the ``neighbour_links`` between
    these spots, so no group makes pairs by the square.
    """
    spot = F.struct("key", "pos").alias("spot")
    rows = fingerprints(docs.select("key", position(F.col("text")).alias("pos"), "text"),
                        words=words)
    spots = written(rows.select(spot, "fp").join(first.select(spot), "spot", "left_semi")
                    .dropDuplicates(["spot"]))
    prints = written(spots.groupBy("fp").agg(F.min("spot").alias("least")))
    same = (spots.join(prints, "fp").where("spot <> least")
            .select(F.col("spot").alias("line"), F.col("least").alias("match")))
    links = neighbour_links(prints.select(F.col("fp").alias("id"), "fp"), distance)
    for end in ("a", "b"):
        links = links.join(prints.select(F.col("fp").alias(end),
                                         F.col("least").alias(f"spot_{end}")), end)
    return same.unionByName(links.select(F.greatest("spot_a", "spot_b").alias("line"),
                                         F.least("spot_a", "spot_b").alias("match")))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5,
             ratio: tuple[int, int] = (4, 5), distance: int = 2) -> DataFrame:
    """``docs`` with one row of every component, columns as they are.

    Texts are linked if the Jaccard similarity of their ``words``-word shingles
    is ``ratio`` or more. Texts whose SimHash fingerprints of these shingles
    differ in ``distance`` bits at most are compared first; a prefix join
    (``TextJoin``) adds the similar ones whose fingerprints lie further apart,
    so the components are exact. Texts without words, null ones among them, are
    one component. The row with the smallest key stays, null last; of rows with
    that key the one with the smallest hash of its text, and one of repeated
    rows. A null text counts as an empty one and stays null if its row stays.
    """
    tie = F.xxhash64(text)
    order = F.struct(F.col("key").isNull().alias("none"), "key", "tie")
    rows = docs.select(F.col(key).alias("key"), tie.alias("tie"), F.col(text).alias("text"))
    join = TextJoin(docs, lambda first: close_pairs(rows, first, words=words, distance=distance),
                    key=key, text=text, ratio=ratio, shingle=words)
    blank = ~F.coalesce(has_word(F.col("text")), F.lit(False))
    silent = (rows.where(blank).groupBy().agg(F.min(order).alias("s"))
              .where("s is not null").select("s.*"))
    classes = join.classes().select("key", "tie", "cls", "cls2")
    folded = classes.groupBy("cls", "cls2").agg(F.min(order).alias("s"))
    chosen = written(folded.join(join.parts(), ["cls", "cls2"]).groupBy("part")
                     .agg(F.min("s").alias("s")).select("s.*").unionByName(silent))
    stay = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), tie.alias("tie"))
    kept = docs.withColumn(own_name(docs, "stays"), stay)
    mark = kept.columns[-1]
    kept = kept.join(chosen.select(F.struct("none", "key", "tie").alias(mark)), mark, "left_semi")
    again = rows.groupBy("key", "tie").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not again.isEmpty():
        kept = kept.dropDuplicates([mark])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
