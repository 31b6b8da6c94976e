"""Sampled subword segmentations without replacement, and their decoding.

The pieces of a SentencePiece vocabulary span a lattice over a text; a path's
probability is in proportion to the product of its pieces' probabilities. A
perturbed A-star search emits the k paths with the greatest Gumbel-perturbed
log probabilities, which are k draws without replacement (Kool et al., 2019).

Sets of paths are the nodes of the search. The greatest perturbed value of a
set is a Gumbel value at the logarithm of its mass, which backward sums over
the lattice give exactly, so a set is split only when it reaches the top of
the queue: its best path is drawn, and the rest falls into sets by where and
how they leave that path. No set is ever dropped, whatever the text's length.

The lattice falls apart at places that no piece covers, mostly before words.
Equal stretches of a batch are built once, and all stretches of all texts are
walked together in arrays.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changerisk.llm.columns import own_name
from changerisk.llm.ctph import powers_for

#: Where the public vocabularies lie; a parameter of every entry point.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Code of a space mark that stands in the text itself; no piece has it.
LITERAL_MARK = 0x110000
#: Code points worked on at once.
CHARS = 1 << 17
#: Ids decoded at once.
IDS = 1 << 16
_MASK = (1 << 64) - 1
_A, _B, _C = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_BACK = pow(_A, -1, 1 << 64)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id: ``(piece, kind)`` with kind ``piece``, ``byte`` or ``other``; log weights."""

    pieces: tuple[tuple[str, str], ...]
    weights: tuple[float, ...]

    @classmethod
    def load(cls, path: str = MODEL, scores: str = "rank") -> Vocabulary:
        """From a SentencePiece file, read on the driver alone.

        A BPE vocabulary holds merge ranks instead of log probabilities;
        ``scores="rank"`` weighs the piece of rank r by 1 / (r + 2), which is
        Zipf's law. ``scores="model"`` takes the file's scores as they are.
        """
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        pieces = tuple((model.id_to_piece(i), "byte" if model.is_byte(i) else "other"
                        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
                        else "piece") for i in range(count))
        given = [model.get_score(i) for i in range(count)]
        if scores == "rank":
            order = sorted((i for i in range(count) if pieces[i][1] == "piece"),
                           key=lambda i: (-given[i], i))
            rank = {i: r for r, i in enumerate(order)}
            given = [-math.log(rank.get(i, count) + 2) for i in range(count)]
        return cls(pieces, tuple(given))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The last step of SplitMix64, on whole arrays."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(_B)
    x ^= x >> np.uint64(27)
    x *= np.uint64(_C)
    x ^= x >> np.uint64(31)
    return x


def _uniform(seed: int, *place: int) -> float:
    """A number between 0 and 1 that the row's seed and the place decide."""
    x = seed
    for p in place:
        x = (x + (p + 1) * _A) & _MASK
        x = ((x ^ (x >> 30)) * _B) & _MASK
        x = ((x ^ (x >> 27)) * _C) & _MASK
        x ^= x >> 31
    return ((x >> 11) + 0.5) / (1 << 53)


def _gumbel_below(mass: float, top: float, u: float) -> float:
    """A Gumbel value at location ``mass``, given that it is at most ``top``."""
    noise = math.log(-math.log(u))
    a = mass - top
    high, low = (a, noise) if a > noise else (noise, a)
    return mass - (high + math.log1p(math.exp(low - high)))


class Decoder:
    """The bytes of all pieces."""

    def __init__(self, vocabulary: Vocabulary):
        texts = [bytes([int(p[1:-1], 16)]) if kind == "byte" else
                 p.replace(SPACE, " ").encode() if kind == "piece" else b""
                 for p, kind in vocabulary.pieces]
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        """Text of a sequence of ids; bytes that are no UTF-8 become replacement marks."""
        ids = np.asarray(ids, dtype=np.int64)
        if not ids.size:
            return ""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - n), n)
        return self.bytes[at].tobytes().decode("utf-8", "replace")[1:]


class Path:
    """A path of one text: node, edge and log probability of every step."""

    __slots__ = ("at", "edge", "cum")

    def __init__(self, at: np.ndarray, edge: np.ndarray, log_q: np.ndarray):
        self.at, self.edge = at, edge
        self.cum = np.zeros(log_q.size + 1)
        np.cumsum(log_q, out=self.cum[1:])

    def mass(self, start: int, end: int) -> float:
        """Log mass of the paths that leave this one at a step from ``start`` to ``end``."""
        gone = self.cum[end] - self.cum[start]
        return self.cum[start] + math.log(-math.expm1(gone)) if gone < 0 else -math.inf


class Sampler:
    """Vocabulary as arrays: a trie in one hash table, and piece bytes."""

    def __init__(self, vocabulary: Vocabulary):
        pieces = vocabulary.pieces
        self.byte_ids = np.full(256, -1, dtype=np.int64)
        # Spaces may only lead a piece: else it would reach over a word's start.
        usable = [(p, i) for i, (p, kind) in enumerate(pieces)
                  if kind == "piece" and p and SPACE not in p.lstrip(SPACE)]
        for i, (p, kind) in enumerate(pieces):
            if kind == "byte":
                self.byte_ids[int(p[1:-1], 16)] = i
        nodes: dict[tuple[int, int], int] = {}
        ends = [-1]
        for p, i in usable:
            node = 0
            for c in map(ord, p):
                key = (node, c)
                if key not in nodes:
                    nodes[key] = len(ends)
                    ends.append(-1)
                node = nodes[key]
            ends[node] = i
        self.ends = np.array(ends, dtype=np.int64)
        self.longest = max((len(p) for p, _ in usable), default=1)
        # Which code points stand next to each other in some piece: one bit for each pair.
        known = sorted({c for _, c in nodes})
        self.index = np.zeros(LITERAL_MARK + 1, dtype=np.int64)
        self.index[known] = np.arange(1, len(known) + 1)
        self.side = len(known) + 1
        self.roots = np.zeros(self.side, dtype=np.int64)
        self.roots[1:] = [nodes.get((0, c), 0) for c in known]
        joined = np.zeros(self.side * self.side // 8 + 1, dtype=np.uint8)
        pairs = np.array(sorted({int(self.index[ord(a)]) * self.side + int(self.index[ord(b)])
                                 for p, _ in usable for a, b in zip(p, p[1:], strict=False)}),
                         dtype=np.int64)
        np.bitwise_or.at(joined, pairs >> 3, (1 << (pairs & 7)).astype(np.uint8))
        self.joined = joined
        size = 1 << max(4, (4 * len(nodes)).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.keys = np.full(size + 64, -1, dtype=np.int64)
        self.next = np.zeros(size + 64, dtype=np.int64)
        for (node, c), child in nodes.items():
            key = node << 21 | c
            slot = ((key * _A) & _MASK) >> int(self.shift)
            while self.keys[slot] >= 0:
                slot = (slot + 1) % self.keys.size
            self.keys[slot], self.next[slot] = key, child
        weights = np.array(vocabulary.weights)
        total = np.logaddexp.reduce(weights[[i for _, i in usable]]) if usable else 0.0
        # One byte piece for each byte of a code point, each as likely as the least likely piece.
        self.least = float(weights[[i for _, i in usable]].min() - total) if usable else -10.0
        self.log_p = np.append(weights - total, self.least)

    def _child(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Trie steps; 0 where there is none."""
        key = (node << 21) | code
        with np.errstate(over="ignore"):
            slot = ((key.astype(np.uint64) * np.uint64(_A)) >> self.shift).astype(np.int64)
        held = self.keys.take(slot)
        same = held == key
        out = self.next.take(slot) * same
        open_ = np.flatnonzero(~same & (held >= 0))
        while open_.size:
            slot[open_] = (slot[open_] + 1) % self.keys.size
            held = self.keys[slot[open_]]
            match = held == key[open_]
            out[open_[match]] = self.next[slot[open_[match]]]
            open_ = open_[~match & (held >= 0)]
        return out

    def codes(self, text: str) -> np.ndarray:
        """Code points behind a leading space, spaces as marks."""
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        raw = np.where(raw == ord(SPACE), LITERAL_MARK, raw)
        return np.concatenate([[ord(SPACE)], np.where(raw == 0x20, ord(SPACE), raw)])

    def sample(self, texts: list[str], seeds: list[int], k: int, alpha: float
               ) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For every text up to ``k`` of (ids, log probability, perturbed, inclusion)."""
        out: list[list[tuple[np.ndarray, float, float, float]]] = []
        at = 0
        while at < len(texts):
            to = group_end(map(len, texts[at:]), at)
            out += _Lattice(self, texts[at:to], alpha).search(seeds[at:to], k)
            at = to
        return out


def group_end(lengths: Iterable[int], at: int) -> int:
    """End of the texts from ``at`` that are worked on at once: one, or more of ``CHARS`` in all."""
    size = 0
    for n in lengths:
        size += n + 1
        if size > CHARS and size > n + 1:
            break
        at += 1
    return at


@lru_cache(maxsize=1)
def _sampler(vocabulary: Vocabulary) -> Sampler:
    """Built once in a worker, whatever the number of its tasks."""
    return Sampler(vocabulary)


@lru_cache(maxsize=1)
def _decoder(vocabulary: Vocabulary) -> Decoder:
    return Decoder(vocabulary)


class _Lattice:
    """All texts of a group: stretches, their distinct forms, edges and path sampling."""

    def __init__(self, sampler: Sampler, texts: list[str], alpha: float):
        self.s = sampler
        parts = [sampler.codes(t) if t else np.zeros(0, dtype=np.int64) for t in texts]
        self.sizes = np.array([p.size for p in parts], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.code = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        if self.code.size:
            self._stretches()
            self._edges(alpha)

    def _stretches(self) -> None:
        """Cuts between code points that no piece has next to each other."""
        code = self.code
        index = self.s.index[code]
        pair = index[:-1] * self.s.side + index[1:]
        begin = np.ones(code.size, dtype=bool)
        begin[1:] = (self.s.joined[pair >> 3] >> (pair & 7).astype(np.uint8)) & 1 == 0
        begin[self.first[:-1][self.sizes > 0]] = True
        self.begin = np.flatnonzero(begin)
        length = np.diff(np.append(self.begin, code.size))
        with np.errstate(over="ignore"):
            back = powers_for(_BACK, code.size + 1)[self.begin]
            hashes = []
            for salt in (1, 0x5851F42D4C957F2D):
                value = _mixed(code.astype(np.uint64) + np.uint64(salt))
                sums = np.zeros(code.size + 1, dtype=np.uint64)
                np.cumsum(value * powers_for(_A, code.size + 1)[:code.size], out=sums[1:])
                hashes.append((sums[self.begin + length] - sums[self.begin]) * back)
        _, one, self.form = np.unique(hashes[0], return_index=True, return_inverse=True)
        if (hashes[1] != hashes[1][one][self.form]).any() or (
                length != length[one][self.form]).any():
            one = self.form = np.arange(self.begin.size)
        self.length = length[one]
        # Distinct forms one after the other, with a node after each one's last.
        starts = np.cumsum(self.length) - self.length
        inside = np.arange(self.length.sum()) - np.repeat(starts, self.length)
        self.chars = code[np.repeat(self.begin[one], self.length) + inside]
        self.root = starts + np.arange(self.length.size)
        self.end = self.root + self.length
        self.node = inside + np.repeat(self.root, self.length)
        self.left = np.repeat(self.length, self.length) - inside

    def _edges(self, alpha: float) -> None:
        """All pieces at all places, backward sums, and the chance of every edge at its node."""
        at = np.arange(self.chars.size)
        found = []
        degree = np.zeros(at.size, dtype=np.int64)
        state = self.s.roots[self.s.index[self.chars]]
        for n in range(1, self.s.longest + 1):
            if n > 1:
                state = self.s._child(state, self.chars[at + n - 1])
            alive = np.flatnonzero(state)
            at, state = at[alive], state[alive]
            ends = self.s.ends[state]
            hit = np.flatnonzero(ends >= 0)
            places = at[hit]
            shorter = degree[places]
            degree[places] = shorter + 1
            found.append((places, shorter, ends[hit] << 16 | n))
            if n == 1:
                alone = np.flatnonzero(degree == 0)
            more = np.flatnonzero(self.left[at] > n)
            at, state = at[more], state[more]
            if not at.size:
                break
        found.append((alone, degree[alone], np.full(alone.size, -1 << 16 | 1)))
        degree[alone] += 1
        # Edges lie by what is left of the form behind their place, then by place, a byte
        # first, then long pieces before short ones.
        most = int(self.left.max())
        order = np.argsort(self.left.astype(np.uint16) if most < 1 << 16 else self.left,
                           kind="stable")
        heads = np.concatenate([[0], np.cumsum(degree[order])])
        last = np.empty(degree.size, dtype=np.int64)
        last[order] = heads[1:] - 1
        packed = np.empty(int(heads[-1]), dtype=np.int64)
        for places, shorter, edge in found:
            packed[last[places] - shorter] = edge
        del found
        self.piece, self.step = packed >> 16, packed & 0xFFFF
        weight = self.s.log_p[self.piece]  # -1 picks the last: a byte
        first = last[alone] - degree[alone] + 1
        weight[first] *= _utf8_length(self.chars[alone])
        weight *= alpha
        nodes = self.node[order]
        start = np.repeat(nodes, degree[order])
        self.to = start + self.step
        # Backward sums, from the last places of all forms to the first.
        beta = np.zeros(self.chars.size + self.length.size)
        cuts = np.searchsorted(self.left[order], np.arange(1, most + 2))
        for c, d, a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), heads[cuts[:-1]].tolist(),
                              heads[cuts[1:]].tolist(), strict=True):
            if a < b:
                value = weight[a:b] + beta[self.to[a:b]]
                beta[nodes[c:d]] = np.logaddexp.reduceat(value, heads[c:d] - a)
        self.log_q = weight + beta[self.to] - beta[start]
        self.low = np.zeros(beta.size, dtype=np.int64)
        self.high = np.zeros(beta.size, dtype=np.int64)
        self.low[nodes], self.high[nodes] = heads[:-1], heads[1:]
        self.log_q[last[degree == 1]] = 0.0
        self.q = np.exp(self.log_q)
        # For the walk, which takes a place's last edge whatever is left.
        self.scan = self.q.copy()
        self.scan[last] = np.inf
        # Ids of edges, -2 where a code point takes several bytes.
        self.id_of = self.piece.astype(np.int32)
        code = self.chars[alone]
        self.id_of[first] = np.where(code < 0x80, self.s.byte_ids[np.minimum(code, 127)], -2)

    def _walk(self, node: np.ndarray, at: np.ndarray, seed: np.ndarray, last: np.ndarray,
              edge_at: np.ndarray) -> None:
        """Draws edges from ``node`` at text places ``at`` to the stretch's last node."""
        while node.size:
            with np.errstate(over="ignore"):
                r = _mixed(seed + at.astype(np.uint64) * np.uint64(_A))
            u = (r >> np.uint64(11)).astype(np.float64)
            u /= 1 << 53
            edge = self.low.take(node)
            u -= self.scan.take(edge)
            open_ = np.flatnonzero(u >= 0)
            some, rest = edge.take(open_), u.take(open_)
            while open_.size:
                some += 1
                rest -= self.scan.take(some)
                edge[open_] = some
                on = np.flatnonzero(rest >= 0)
                open_, some, rest = open_.take(on), some.take(on), rest.take(on)
            edge_at[at] = edge
            step = self.step.take(edge)
            node, at = node + step, at + step
            on = np.flatnonzero(node < last)
            node, at, seed, last = node.take(on), at.take(on), seed.take(on), last.take(on)

    def _draw(self, rows: list[int], nodes: list[int], places: list[int], seeds: list[int]
              ) -> dict[int, np.ndarray]:
        """Edges by place of a fresh path from (node, place) to the text's end, for each row."""
        edge_at = np.full(self.code.size, -1, dtype=np.int64)
        node, at, seed, last = [], [], [], []
        for row, n, place, s in zip(rows, nodes, places, seeds, strict=True):
            to = int(np.searchsorted(self.begin, self.first[row + 1]))
            here = int(np.searchsorted(self.begin, place, "right")) - 1
            some = np.arange(here if n >= 0 else here + 1, to) if n >= 0 else \
                np.arange(int(np.searchsorted(self.begin, place)), to)
            form = self.form[some]
            starts, places_ = self.root[form].copy(), self.begin[some].copy()
            if n >= 0 and some.size:
                starts[0], places_[0] = n, place
            node.append(starts)
            at.append(places_)
            last.append(self.end[form])
            seed.append(np.full(some.size, s, dtype=np.uint64))
        if node:
            self._walk(np.concatenate(node), np.concatenate(at), np.concatenate(seed),
                       np.concatenate(last), edge_at)
        return {row: edge_at[place:self.first[row + 1]]
                for row, place in zip(rows, places, strict=True)}

    def _path(self, at: np.ndarray, edge: np.ndarray) -> Path:
        return Path(at, edge, self.log_q.take(edge))

    def search(self, seeds: list[int], k: int
               ) -> list[list[tuple[np.ndarray, float, float, float]]]:
        rows = [r for r in range(self.sizes.size) if self.sizes[r]]
        begin = [int(self.first[r]) for r in rows]
        queue: dict[int, list] = {}
        found: dict[int, list[tuple[Path, float]]] = {}
        # Places are counted from the text's start, so that batches make no difference.
        fresh = {r: _seed(seeds[r], 0, int(self.first[r])) for r in rows}
        drawn = self._draw(rows, [-1] * len(rows), begin, [fresh[r] for r in rows])
        for r in rows:
            at = np.flatnonzero(drawn[r] >= 0)
            path = self._path(at + self.first[r], drawn[r][at])
            top = -math.log(-math.log(_uniform(seeds[r], 1, 0)))
            found[r] = [(path, top)]
            queue[r] = []
            self._push(queue[r], seeds[r], top, ("leave", path, 0, path.edge.size), 0)
        for round_ in range(1, k):
            work = []
            for r in rows:
                if queue[r]:
                    work.append((r, *self._pop(queue[r], seeds[r], round_)))
            if not work:
                break
            drawn = self._draw(
                [w[0] for w in work], [self._after(w[3])[0] for w in work],
                [int(w[1].at[w[2]]) + int(self.step[w[3]]) for w in work],
                [_seed(seeds[w[0]], round_, int(self.first[w[0]])) for w in work])
            for r, old, t, edge, top, rest in work:
                place = int(old.at[t]) + int(self.step[edge])
                more = np.flatnonzero(drawn[r] >= 0)
                new = self._path(np.concatenate([old.at[:t + 1], more + place]),
                                 np.concatenate([old.edge[:t], [edge], drawn[r][more]]))
                found[r].append((new, top))
                sets = [*rest, ("leave", new, t + 1, new.edge.size)]
                for number, s in enumerate(sets):
                    self._push(queue[r], seeds[r], top, s, round_ * 8 + number)
        paths = [p for r in rows for p, _ in found[r]]
        spelled: dict[int, np.ndarray] = {}
        if paths:
            ends = np.cumsum([p.edge.size for p in paths]).tolist()
            starts = [0, *ends[:-1]]
            ids = self.id_of.take(np.concatenate([p.edge for p in paths]))
            spelled = {id(p): self._ids(p) if bare else ids[a:b] for p, bare, a, b in
                       zip(paths, np.logical_or.reduceat(ids < 0, starts), starts, ends,
                           strict=True)}
        out = []
        for r in range(self.sizes.size):
            if not self.sizes[r]:
                out.append([(np.zeros(0, dtype=np.int32), 0.0,
                             -math.log(-math.log(_uniform(seeds[r], 1, 0))), 1.0)])
                continue
            bar = -queue[r][0][0] if queue[r] else -math.inf
            out.append([(spelled[id(p)], min(0.0, float(p.cum[-1])), g,
                         -math.expm1(-math.exp(min(700.0, float(p.cum[-1]) - bar)))
                         if bar > -math.inf else 1.0) for p, g in found[r]])
        return out

    def _after(self, edge: int) -> tuple[int]:
        """Node after an edge, or -1 at the end of a stretch."""
        to = int(self.to[edge])
        return (-1 if self.high[to] == self.low[to] else to,)

    def _push(self, queue: list, seed: int, top: float, some: tuple, number: int) -> None:
        if some[0] == "leave":
            mass = some[1].mass(some[2], some[3])
        else:
            _, path, t, gone = some
            node = self._node(path, t)
            left = sum(float(self.q[e]) for e in range(self.low[node], self.high[node])
                       if e not in gone)
            mass = path.cum[t] + math.log(left) if left > 0 else -math.inf
        if mass > -math.inf:
            value = _gumbel_below(mass, top, _uniform(seed, 2, number))
            heapq.heappush(queue, (-value, number, some))

    def _node(self, path: Path, t: int) -> int:
        edge = int(path.edge[t])
        return int(self.to[edge] - self.step[edge])

    def _pop(self, queue: list, seed: int, round_: int) -> tuple:
        """Where the best path of the best set leaves its parent, and what else the set holds."""
        value, _, some = heapq.heappop(queue)
        if some[0] == "leave":
            _, path, a, b = some
            gone = -np.expm1(path.cum[a + 1:b + 1] - path.cum[a])
            t = a + int(np.searchsorted(gone, _uniform(seed, 3, round_) * gone[-1], "right"))
            t = min(t, b - 1)
            while self.log_q[path.edge[t]] == 0.0:  # rounding at the last step only
                t -= 1
            without = (int(path.edge[t]),)
            rest = [("leave", path, a, t), ("leave", path, t + 1, b)]
        else:
            _, path, t, without = some
            rest = []
        node = self._node(path, t)
        choice = [e for e in range(int(self.low[node]), int(self.high[node])) if e not in without]
        u = _uniform(seed, 4, round_) * sum(float(self.q[e]) for e in choice)
        edge = choice[-1]
        for e in choice:
            u -= float(self.q[e])
            if u < 0:
                edge = e
                break
        rest.append(("other", path, t, (*without, edge)))
        return path, t, edge, -value, rest

    def _ids(self, path: Path) -> np.ndarray:
        """Piece ids, code points without a piece as the ids of their bytes."""
        ids = self.piece[path.edge]
        bare = ids < 0
        code = self.code[path.at]
        code = np.where(code == LITERAL_MARK, ord(SPACE), code)
        many = np.where(bare, _utf8_length(code), 1)
        which = np.repeat(np.arange(ids.size), many)
        nth = np.arange(which.size) - np.repeat(np.cumsum(many) - many, many)
        n, c = many[which], code[which]
        lead = np.select([n == 1, n == 2, n == 3], [0, 0xC0, 0xE0], 0xF0)
        shift = 6 * (n - 1 - nth)
        value = np.where(nth == 0, lead | (c >> shift), 0x80 | ((c >> shift) & 0x3F))
        return np.where(bare[which], self.s.byte_ids[np.minimum(value, 255)],
                        ids[which]).astype(np.int32)


def _seed(seed: int, round_: int, first: int) -> int:
    """Seed of a round's draws, so shifted that place 0 is the text's start."""
    x = (seed + (round_ + 1) * _B) & _MASK
    x = ((x ^ (x >> 30)) * _C) & _MASK
    return (x - first * _A) & _MASK


def _utf8_length(code: np.ndarray) -> np.ndarray:
    return 1 + (code >= 0x80) + (code >= 0x800) + ((code >= 0x10000) & (code != LITERAL_MARK))


def encode(docs: DataFrame, vocabulary: Vocabulary, *, key: str = "doc_id", text: str = "text",
           keep: list[str] | None = None, k: int = 3, alpha: float = 1.0,
           seed: int = 1) -> DataFrame:
    """Up to ``k`` distinct sampled segmentations of every text, best perturbed value first.

    Adds ``sample`` (1 to k), ``ids``, ``log_prob`` (of the segmentation, over
    all of the text), ``perturbed`` and ``inclusion`` (the chance to be among
    the samples given the first value left out, as used for importance weights;
    1 if nothing is left out) to ``keep`` (the key if not given). ``alpha``
    flattens (under 1) or sharpens the probabilities.

    The row's key and ``seed`` decide on all draws, so batches, partitions and
    repeated runs make no difference, and rows with equal key and text get
    equal samples. A null text is an empty one; an empty text has one, empty
    segmentation. Texts with fewer segmentations than ``k`` give fewer rows. A
    name that ``keep`` has already gets ``_1`` after it. The vocabulary is sent
    to every task; its size bounds the broadcast.
    """
    keep = keep if keep is not None else [key]
    added = ("sample int, ids array<int>, log_prob double, perturbed double, inclusion double")
    names = [c.split()[0] for c in added.split(", ")]
    own = [own_name(keep, n) for n in names]
    for name, mine in zip(names, own, strict=True):
        added = added.replace(f"{name} ", f"`{mine}` ", 1)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(sent.value)
        for batch in batches:
            texts = batch.column("__text")
            lengths = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            seeds = batch.column("__seed").to_pylist()
            rest = batch.select([n for n in batch.schema.names if n not in ("__text", "__seed")])
            at = 0
            while at < batch.num_rows:
                to = group_end(lengths[at:], at)
                some = [t or "" for t in texts.slice(at, to - at).to_pylist()]
                drawn = sampler.sample(some, [s & _MASK for s in seeds[at:to]], k, alpha)
                flat = [x for found in drawn for x in found]
                owner = np.repeat(np.arange(at, to), [len(f) for f in drawn])
                offsets = np.concatenate([[0], np.cumsum([x[0].size for x in flat])])
                made = rest.take(pa.array(owner))
                yield pa.RecordBatch.from_arrays(
                    [*made.columns,
                     pa.array(np.concatenate([np.arange(1, len(f) + 1) for f in drawn]),
                              pa.int32()),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(
                         np.concatenate([x[0] for x in flat]), pa.int32())),
                     *[pa.array([float(x[i]) for x in flat], pa.float64()) for i in (1, 2, 3)]],
                    names=[*rest.schema.names, *own])
                at = to
            # Nothing of a batch is held while the next one comes.
            batch = texts = rest = some = drawn = flat = made = None
            pa.default_memory_pool().release_unused()

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(
        *[F.col(f"`{c}`") for c in keep], F.col(text).alias("__text"),
        F.xxhash64(F.col(key).cast("string"), F.lit(seed)).alias("__seed")).mapInArrow(
        run, f"{kept}, {added}")


def decoded_parts(batch: pa.RecordBatch, decoder: Decoder, ids: str, into: str
                  ) -> Iterator[pa.RecordBatch]:
    """The batch with its texts, in parts of ``IDS`` ids or of one row, whose texts alone are held."""
    column = batch.column(ids)
    values = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    known = column.is_valid().to_pylist()
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + IDS, "right")) - 1)
        texts = [decoder.decode(values[a:b]) if ok else None for a, b, ok in
                 zip(offsets[at:to], offsets[at + 1:to + 1], known[at:to], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*batch.slice(at, to - at).columns, pa.array(texts, pa.string())],
            names=[*batch.schema.names, into])
        at = to


def decode(encoded: DataFrame, vocabulary: Vocabulary, *, ids: str = "ids",
           into: str = "decoded") -> DataFrame:
    """Adds the text of ``ids`` to all columns; ``into`` gets ``_1`` after it if it is in use.

    Null ids give a null text, an empty list the empty text; ids outside the
    vocabulary are an error. The exact inverse of ``encode``.
    """
    into = own_name(encoded, into)
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from decoded_parts(batch, _decoder(sent.value), ids, into)
            del batch
            pa.default_memory_pool().release_unused()

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{kept}, `{into}` string")
