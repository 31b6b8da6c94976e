"""Alignment of two tokenizers over the same bytes.

Both token sequences of a text spell the same bytes, so each is a list of byte
ends. The shorter list is intersected with the longer by galloping: every end is
sought from where its block of ends begins, first in steps that double, then by
halves. Common ends cut both sequences into groups, and the differences of
neighbouring ranks are the ranges of tokens that overlap. All ends of a stretch
of texts are sought together in arrays.

Links are counted over the corpus in two steps. A stretch folds its links to
distinct id pairs before anything is shuffled; only these pairs meet their
counts, and come back to the stretch, whose size is bounded.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changerisk.llm.columns import own_name
from changerisk.llm.scratch import Scratch

#: Where the public vocabularies lie; parameters of every entry point.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of text that a stretch has; a single text may have more.
STRETCH = 1 << 20
#: How texts are cut before byte-level merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass
class ByteBpe:
    """Byte-level BPE; ``tokens`` are the bytes of every id, in order of their merges."""

    tokens: list[bytes]
    _encoding: object = field(default=None, repr=False)

    @classmethod
    def load(cls, path: str = BYTE_BPE) -> ByteBpe:
        """From a ``tokenizers`` file, read on the driver alone.

        Merging by the rank of the merged bytes gives the file's own ids if ids
        count its merges, which is checked; special tokens are left out, so
        their strings in a text are ordinary text.
        """
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = byte_letters(), model["vocab"]
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if any(vocab[m] != 256 + i for i, m in enumerate(merged)):
            raise ValueError("ids do not follow the merges")
        tokens = [b""] * (256 + len(merged))
        for word, i in vocab.items():
            if i < len(tokens):
                tokens[i] = bytes(letters[c] for c in word)
        return cls(tokens)

    def __getstate__(self):
        return {"tokens": self.tokens, "_encoding": None}

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self._encoding is None:
            self._encoding = tiktoken.Encoding(
                "byte_bpe", pat_str=PATTERN, special_tokens={},
                mergeable_ranks={t: i for i, t in enumerate(self.tokens)})
        return [self._encoding.encode_ordinary(" " + t) for t in texts]


@dataclass
class PieceModel:
    """A SentencePiece model, which puts a space before every text itself."""

    proto: bytes
    tokens: list[bytes]
    _model: object = field(default=None, repr=False)

    @classmethod
    def load(cls, path: str = PIECES) -> PieceModel:
        """From a model file, read on the driver alone."""
        with open(path, "rb") as f:
            proto = f.read()
        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        return cls(proto, [bytes([int(p[1:-1], 16)]) if model.is_byte(i)
                           else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)])

    def __getstate__(self):
        return {"proto": self.proto, "tokens": self.tokens, "_model": None}

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self._model is None:
            self._model = sentencepiece.SentencePieceProcessor(model_proto=self.proto)
        return self._model.encode(texts, num_threads=1)


def _seek(hay: np.ndarray, needles: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For every needle the number of smaller values in ``hay``, known to be ``low`` at least."""
    low, high = low.copy(), np.full(needles.size, hay.size)
    lanes, step = np.arange(needles.size), 1
    while lanes.size:
        at = low[lanes] + step - 1
        inside = at < hay.size
        lanes, at = lanes[inside], at[inside]
        below = hay[at] < needles[lanes]
        high[lanes[~below]] = at[~below]
        lanes, at = lanes[below], at[below]
        low[lanes] = at + 1
        step *= 2
    lanes = np.flatnonzero(low < high)
    while lanes.size:
        middle = (low[lanes] + high[lanes]) >> 1
        below = hay[middle] < needles[lanes]
        low[lanes[below]] = middle[below] + 1
        high[lanes[~below]] = middle[~below]
        lanes = lanes[low[lanes] < high[lanes]]
    return low


def gallop(hay: np.ndarray, needles: np.ndarray, block: int = 16) -> np.ndarray:
    """Ranks of ascending ``needles`` in ascending ``hay``: exponential, then binary search.

    The first needle of every block of ``block`` is sought first, itself by
    galloping among the blocks; the others start from its rank.
    """
    if needles.size <= block:
        return _seek(hay, needles, np.zeros(needles.size, dtype=np.int64))
    heads = gallop(hay, needles[::block], block)
    return _seek(hay, needles, np.repeat(heads, block)[: needles.size])


@dataclass
class Overlap:
    """Tokens of two sequences over the same bytes: common ends and overlapping pairs.

    ``cut_a``, ``cut_b``: places of the tokens that end together. ``link_a``,
    ``link_b``: places of every two tokens that share a byte.
    """

    cut_a: np.ndarray
    cut_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def overlap(ends_a: np.ndarray, ends_b: np.ndarray) -> Overlap:
    """Groups and links of two ascending lists of byte ends with the same last end."""
    if ends_a.size > ends_b.size:
        x = overlap(ends_b, ends_a)
        return Overlap(x.cut_b, x.cut_a, x.link_b, x.link_a)
    if not ends_a.size:
        none = np.zeros(0, dtype=np.int64)
        return Overlap(none, none, none, none)
    rank = gallop(ends_b, ends_a)
    common = ends_b[rank] == ends_a
    # A token overlaps those from the rank of its start to the rank of its end.
    first = np.concatenate([[0], (rank + common)[:-1]])
    counts = rank - first + 1
    link_a = np.repeat(np.arange(ends_a.size), counts)
    link_b = np.arange(link_a.size) - np.repeat(np.cumsum(counts) - counts - first, counts)
    return Overlap(np.flatnonzero(common), rank[common], link_a, link_b)


@dataclass
class Stretch:
    """Aligned texts: per text its first places and, for all together, ids and their overlap."""

    a: np.ndarray
    b: np.ndarray
    begin_a: np.ndarray
    begin_b: np.ndarray
    over: Overlap

    def groups(self) -> np.ndarray:
        """First group of every text, and behind the last."""
        return np.searchsorted(self.over.cut_a, self.begin_a)

    def link_text(self) -> np.ndarray:
        """Text of every link."""
        return np.searchsorted(self.begin_a, self.over.link_a, side="right") - 1


class Aligner:
    """Two tokenizers, each with ``tokens`` and ``encode``."""

    def __init__(self, first, second):
        self.first, self.second = first, second
        self._tables = None

    def __getstate__(self):
        return {"first": self.first, "second": self.second, "_tables": None}

    def _lengths(self):
        if self._tables is None:
            self._tables = [np.array([len(t) for t in v.tokens], dtype=np.int64)
                            for v in (self.first, self.second)]
        return self._tables

    def align(self, texts: list[bytes | None]) -> Stretch:
        """All texts of a stretch; null, empty, ill-formed and unequally spelled ones have no token."""
        read, places = [], []
        for i, raw in enumerate(texts):
            try:
                if raw:
                    read.append(bytes(raw).decode())
                    places.append(i)
            except UnicodeDecodeError:
                pass
        found = {}
        one, two = self.first.tokens, self.second.tokens
        for i, a, b in zip(places, self.first.encode(read), self.second.encode(read), strict=True):
            whole = b" " + bytes(texts[i])
            if (b"".join([one[x] for x in a]) == whole
                    and b"".join([two[x] for x in b]) == whole):
                found[i] = (a, b)
        sizes = np.array([[len(x) for x in found.get(i, ((), ()))] for i in range(len(texts))],
                         dtype=np.int64).reshape(len(texts), 2)
        ids = [np.array([x for f in found.values() for x in f[side]], dtype=np.int64)
               for side in (0, 1)]
        ends = [np.cumsum(n[x]) for n, x in zip(self._lengths(), ids, strict=True)]
        begins = np.concatenate([np.zeros((1, 2), dtype=np.int64), np.cumsum(sizes, axis=0)])
        return Stretch(ids[0], ids[1], begins[:, 0], begins[:, 1], overlap(*ends))


class GroupText:
    """The groups of texts as ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, size_a: int, size_b: int):
        self.a = np.array([f"{i}{end}" for i in range(size_a) for end in ",|"], dtype=object)
        self.b = np.array([f"{i}{end}" for i in range(size_b) for end in ",;"], dtype=object)

    def texts(self, s: Stretch) -> list[str]:
        cut_a, cut_b = s.over.cut_a, s.over.cut_b
        out = np.empty(s.a.size + s.b.size, dtype=object)
        for ids, table, own, other, before in ((s.a, self.a, cut_a, cut_b, 0),
                                               (s.b, self.b, cut_b, cut_a, 1)):
            last = np.zeros(ids.size, dtype=np.int64)
            last[own] = 1
            group = np.cumsum(last) - last
            # Before a group's tokens stand the other side's tokens of earlier groups, B's after A's.
            passed = np.concatenate([[0], other + 1])[group + before]
            out[np.arange(ids.size) + passed] = table[2 * ids + last]
        begin = s.begin_a + s.begin_b
        return ["".join(out[i:j])[:-1] for i, j in zip(begin, begin[1:], strict=False)]


def _stretches(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, list]]:
    """Runs of rows with ``STRETCH`` bytes of text or little more."""
    texts, begin, size = batch.column(at).to_pylist(), 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= STRETCH or i + 1 == len(texts):
            yield begin, i + 1, texts[begin:i + 1]
            begin, size = i + 1, 0


def _kept(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
                       F.col(f"`{text}`").cast("binary").alias("text"))


def align(docs: DataFrame, first, second, *, text: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """Adds the groups of every text to ``keep`` (all columns but the text if not given).

    ``groups`` is an array of ``(a, b, end)``: the ids of both tokenizers and the
    byte behind them, counted with the space before the text. Texts that are
    null, empty or spelled differently by a tokenizer have an empty array. If
    ``keep`` has such a name, the new column gets ``_1``. Rows are independent,
    an empty table gives an empty one, and a very long text is one row's work.
    """
    keep = keep if keep is not None else [c for c in docs.columns if c != text]
    name = own_name(keep, "groups")
    sent = docs.sparkSession.sparkContext.broadcast(Aligner(first, second))
    chosen = _kept(docs, keep, text)
    kind = T.StructType.fromDDL("groups array<struct<a:array<int>,b:array<int>,end:bigint>>")
    schema = T.StructType([*chosen.schema.fields[:-1], *kind.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = sent.value
        ids_list = pa.list_(pa.int32())
        arrow = pa.list_(pa.struct([("a", ids_list), ("b", ids_list), ("end", pa.int64())]))
        for batch in batches:
            for i, j, texts in _stretches(batch, batch.num_columns - 1):
                s = aligner.align(texts)
                ends = np.cumsum(aligner._lengths()[0][s.a])[s.over.cut_a]
                of = s.groups()
                base = np.concatenate([[0], ends])[of[:-1]]
                made = []
                for k, (u, v) in enumerate(zip(of, of[1:], strict=False)):
                    pieces = [np.split(ids[begin[k]:begin[k + 1]], cut[u:v][:-1] + 1 - begin[k])
                              for ids, begin, cut in ((s.a, s.begin_a, s.over.cut_a),
                                                      (s.b, s.begin_b, s.over.cut_b))]
                    made.append([] if u == v else [
                        {"a": x, "b": y, "end": e} for x, y, e in
                        zip(*pieces, (ends[u:v] - base[k]).tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [c.slice(i, j - i) for c in batch.columns[:-1]] + [pa.array(made, arrow)],
                    names=schema.names)

    out = chosen.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
                      F.col("groups").alias(name))


#: Columns that ``aligned_counts`` adds.
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def aligned_counts(docs: DataFrame, first, second, *, text: str = "text",
                   keep: list[str] | None = None) -> DataFrame:
    """How the tokens of every text align, and how common its links are in the corpus.

    Adds to ``keep`` (all columns but the text if not given) ``n_a`` and ``n_b``
    tokens, ``n_groups`` between common ends, ``n_links`` pairs of tokens that
    share a byte, ``n_best`` of them whose id pair no other pair of the same
    first id exceeds in documents that hold it linked (ties are best, too),
    ``count_sum`` of these documents over all links, and ``groups_sha256``. A
    null or empty text, or one that a tokenizer spells differently, has no
    token: zeros and an empty hash. Repeated rows count as documents of their
    own. Names that ``keep`` has already get ``_1``. An empty table gives an
    empty one. Whole texts are read; a single text is held whole.
    """
    keep = keep if keep is not None else [c for c in docs.columns if c != text]
    names = []
    for n in COUNTS:
        names.append(own_name(keep + names, n))
    spark = docs.sparkSession
    scratch = Scratch(spark)
    side = len(second.tokens)
    sent = spark.sparkContext.broadcast(Aligner(first, second))
    chosen = _kept(docs, keep, text)
    kept = chosen.schema.fields[:-1]
    counted = T.StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, "
                                   "groups_sha256 string")
    schema = T.StructType([*kept, *counted.fields, *T.StructType.fromDDL(
        "stretch long, pairs array<long>, times array<int>, all_pairs array<long>, "
        "all_docs array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, writer, made = sent.value, None, 0
        task = TaskContext.get().partitionId() << 32
        for batch in batches:
            writer = writer or GroupText(len(aligner.first.tokens), side)
            for i, j, texts in _stretches(batch, batch.num_columns - 1):
                s = aligner.align(texts)
                of_text = s.link_text()
                pairs = s.a[s.over.link_a] * side + s.b[s.over.link_b]
                order = np.lexsort((pairs, of_text))
                pairs, of_text = pairs[order], of_text[order]
                new = np.ones(pairs.size, dtype=bool)
                new[1:] = (pairs[1:] != pairs[:-1]) | (of_text[1:] != of_text[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, pairs.size))
                own, own_text = pairs[at], of_text[at]
                cuts = np.searchsorted(own_text, np.arange(len(texts) + 1))
                distinct, held = np.unique(own, return_counts=True)
                shas = [hashlib.sha256(t.encode()).hexdigest() if t else ""
                        for t in writer.texts(s)]
                links = np.bincount(of_text, minlength=len(texts))
                first_only = np.minimum(np.arange(len(texts) + 1), 1) * distinct.size

                def lists(values, ends, kind):
                    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                                    pa.array(values, kind))

                yield pa.RecordBatch.from_arrays(
                    [c.slice(i, j - i) for c in batch.columns[:-1]] + [
                        pa.array(np.diff(s.begin_a)), pa.array(np.diff(s.begin_b)),
                        pa.array(np.diff(s.groups())), pa.array(links.astype(np.int64)),
                        pa.array(shas), pa.array(np.full(len(texts), task + made)),
                        lists(own, cuts, pa.int64()), lists(times, cuts, pa.int32()),
                        lists(distinct, first_only, pa.int64()),
                        lists(held, first_only, pa.int32())],
                    names=schema.names)
                made += 1

    aligned, _ = scratch.keep(chosen.mapInArrow(run, schema))
    spread = aligned.select("stretch", F.explode(F.arrays_zip("all_pairs", "all_docs")).alias("p")
                            ).select("stretch", F.col("p.all_pairs").alias("pair"),
                                     F.col("p.all_docs").alias("docs"))
    counts, _ = scratch.keep(spread.groupBy("pair").agg(F.sum("docs").alias("n")))
    # One row per id of the first vocabulary at most.
    best = counts.groupBy(F.expr(f"pair div {side}").alias("a")).agg(F.max("n").alias("most"))
    judged = counts.withColumn("a", F.expr(f"pair div {side}")).join(F.broadcast(best), "a").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best"))
    known = spread.select(F.col("stretch").alias("part"), "pair").join(judged, "pair")

    out = T.StructType([*kept, *T.StructType.fromDDL(
        "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string").fields])

    def finish(texts: pa.Table, found: pa.Table) -> pa.Table:
        texts, found = texts.combine_chunks(), found.combine_chunks()
        pair = found.column("pair").to_numpy()
        order = np.argsort(pair)
        n = found.column("n").to_numpy()[order]
        top = found.column("best").to_numpy(zero_copy_only=False)[order]
        lists = texts.column("pairs").combine_chunks()
        at = np.searchsorted(pair[order], lists.flatten().to_numpy())
        times = texts.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(
            zero_copy_only=False))]).astype(np.int64)

        def summed(values):
            total = np.concatenate([[0], np.cumsum(values)])
            return pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64())

        more = {"n_best": summed(times * top[at]), "count_sum": summed(times * n[at])}
        return pa.table([more[c] if c in more else texts.column(c) for c in out.names],
                        names=out.names)

    done = (aligned.drop("all_pairs", "all_docs").groupBy("stretch")
            .cogroup(known.groupBy("part")).applyInArrow(finish, out))
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
                       *[F.col(c).alias(n) for c, n in zip(COUNTS, names, strict=True)])
