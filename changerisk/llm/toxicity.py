"""Toxicity by a weighted finite-state pattern grammar.

Lexical transducers rewrite words as tags: insult, threat, target, negation
and report. Insults and their weights are learned from labelled texts, as whole
words and as stems; the other word lists are fixed. Small weighted machines
read the tags of a clause and are composed into one: negation and reported
speech weaken what they cover, a target strengthens it, and a threat counts
only with a target. A document's weight is the sum over its matched clauses,
turned into a probability by a logistic curve fitted to the same labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.llm.columns import own_name
from changerisk.llm.scratch import written

#: Labelled texts to learn from at most, those with the smallest hashes of their ids.
MAX_LABELLED = 50_000
#: Lengths of stems, in letters.
STEMS = (4, 5, 6, 7)

# Fixed word lists.
TARGETS = frozenset("you your yours yourself u ur he she him her they them dein deine dich dir du "
                    "ihr euch tu toi te ton ta vous votre tú ti usted ustedes vosotros".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't don't nobody nicht kein keine nie ne pas "
                      "jamais nunca jamás tampoco".split())
REPORTS = frozenset("said says wrote writes called quoted reported allegedly claimed sagte sagt "
                    "schrieb dit disait écrit dijo dice escribió according".split())
THREATS = frozenset("kill murder hurt destroy stab shoot strangle töten umbringen verletzen tuer "
                    "blesser frapper matar golpear destruir".split())

WORD, TARGET, NEGATION, REPORT, INSULT, THREAT = range(6)


@dataclass(frozen=True)
class Machine:
    """Deterministic weighted transducer over tags: state and tag give a state and a factor.

    Steps that are not listed go by the tag ``None`` of the state, else stay
    with factor 1.
    """

    steps: dict = field(default_factory=dict)
    start: object = 0

    def step(self, state, tag: int) -> tuple:
        return self.steps.get((state, tag)) or self.steps.get((state, None)) or (state, 1.0)

    def compose(self, other: Machine) -> Machine:
        """The machine that runs both over the same tags and multiplies their factors."""
        start = (self.start, other.start)
        steps, todo, seen = {}, [start], {start}
        while todo:
            state = todo.pop()
            for tag in range(6):
                (a, x), (b, y) = self.step(state[0], tag), other.step(state[1], tag)
                steps[state, tag] = ((a, b), x * y)
                if (a, b) not in seen:
                    seen.add((a, b))
                    todo.append((a, b))
        return Machine(steps, start)

    def run(self, tags: list[int]) -> list[float]:
        state, out = self.start, []
        for tag in tags:
            state, factor = self.step(state, tag)
            out.append(factor)
        return out


def negation(factor: float = 0.5, scope: int = 3) -> Machine:
    """Weakens insults and threats up to ``scope`` words after a negation."""
    steps = {}
    for left in range(scope + 1):
        after = max(0, left - 1)
        weaker = factor if left else 1.0
        steps |= {(left, NEGATION): (scope, 1.0), (left, None): (after, 1.0),
                  (left, INSULT): (after, weaker), (left, THREAT): (after, weaker)}
    return Machine(steps)


def reported(factor: float = 0.7) -> Machine:
    """Weakens what follows a word of speaking in the same clause."""
    return Machine({(0, REPORT): (1, 1.0), (1, INSULT): (1, factor), (1, THREAT): (1, factor)})


def targeted(bonus: float = 1.25) -> Machine:
    """Strengthens insults after a target, and drops threats without one."""
    return Machine({(0, TARGET): (1, 1.0), (0, THREAT): (0, 0.0), (1, INSULT): (1, bonus)})


_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;:\n]")


class Grammar:
    """The composed grammar with a learned lexicon ``{pattern: weight}``.

    ``=word`` is a whole word, anything else a stem. Both are found by one
    automaton over the lower-case text, so texts without a match cost one pass.
    """

    def __init__(self, lexicon: dict[str, float], intercept: float = 0.0, slope: float = 1.0,
                 threat: float = 4.0):
        self.lexicon, self.intercept, self.slope, self.threat = (
            lexicon, intercept, slope, threat)
        covered = negation().compose(reported())
        self.machines = [covered.compose(targeted()), targeted()]
        self._automaton = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"} | {
            "_automaton": None}

    def _found(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            words: dict[str, tuple[float, float, bool]] = {}
            for p, w in self.lexicon.items():
                word = p.removeprefix("=")
                whole, stem, _ = words.get(word, (0.0, 0.0, False))
                words[word] = (max(whole, w), stem if p != word else max(stem, w), False)
            for t in THREATS:
                whole, stem, _ = words.get(t, (0.0, 0.0, False))
                words[t] = (whole, stem, True)
            for word, value in words.items():
                a.add_word(word, (word, *value))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def clauses(self, text: str | None) -> list[tuple[str, float]]:
        """Matched clauses, in lower case, and their weights."""
        low = (text or "").lower()
        hits: dict[int, tuple[float, bool]] = {}
        for end, (word, whole, stem, is_threat) in self._found().iter(low):
            start = end - len(word) + 1
            if start and low[start - 1].isalpha():
                continue
            ended = end + 1 >= len(low) or not low[end + 1].isalpha()
            weight = max(stem, whole if ended else 0.0)
            threat = is_threat and ended
            if weight > 0 or threat:
                old = hits.get(start, (0.0, False))
                hits[start] = (max(old[0], weight), old[1] or threat)
        out, done = [], -1
        for at in sorted(hits):
            if at < done:
                continue
            begin = 0
            # The last end before the match, looked for backwards without a copy.
            begin = max(low.rfind(c, 0, at) for c in ".!?;:\n") + 1
            stop = _CLAUSE_END.search(low, at)
            done = stop.start() if stop else len(low)
            weight = self._weigh(low, begin, done, hits)
            if weight > 0:
                out.append((low[begin:done].strip(), weight))
        return out

    @staticmethod
    def _parts(low: str, begin: int, end: int, hits: dict[int, tuple[float, bool]]
               ) -> Iterator[tuple[str, int]]:
        """Words and their places; one with a match after its apostrophe is two words."""
        for m in _WORDS.finditer(low, begin, end):
            w, at = m.group(), m.start()
            cut = max(w.find("'"), w.find("’")) + 1
            if cut and at + cut in hits:
                yield w[:cut - 1], at
                yield w[cut:], at + cut
            else:
                yield w, at

    def _weigh(self, low: str, begin: int, end: int, hits: dict[int, tuple[float, bool]]) -> float:
        tags, weights = [], []
        for w, at in self._parts(low, begin, end, hits):
            insult, threat = hits.get(at, (0.0, False))
            tags.append(INSULT if insult else THREAT if threat else NEGATION if w in NEGATIONS
                        else REPORT if w in REPORTS else TARGET if w in TARGETS else WORD)
            weights.append(insult or (self.threat if threat else 0.0))
        forward = self.machines[0].run(tags)
        backward = self.machines[1].run(tags[::-1])[::-1]
        alone = Grammar._covered.run(tags)
        return sum(w * max(f, c * b) for w, f, c, b in
                   zip(weights, forward, alone, backward, strict=True) if w)

    #: Negation and report without a target, for targets that come after.
    _covered = negation().compose(reported())

    def weight(self, text: str | None) -> float:
        return sum(w for _, w in self.clauses(text))

    def score(self, weight: float) -> float:
        z = self.intercept + self.slope * math.log1p(weight)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``(text, y)`` of at most ``most`` labelled documents, those with the smallest id hashes.

    ``labels(doc_id, toxic)``; null ids or labels are left out, and an id with
    several labels counts as toxic if one says so. Only the chosen ids are
    broadcast, ``most`` at the utmost.
    """
    chosen = (labels.where("doc_id is not null and toxic is not null")
              .groupBy("doc_id").agg(F.max("toxic").alias("__y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    return docs.join(F.broadcast(chosen), "doc_id").where("text is not null").select(
        "text", (F.col("__y") > 0).cast("int").alias("y"))


def learn(sample: DataFrame) -> Grammar:
    """Lexicon and curve from ``sample(text, y)``, read from the shared folder several times.

    Support of a pattern is the number of toxic texts that have it or, if
    smaller, of different words it follows there, so copies of one passage
    count once; it is set against the number of other texts that have it. Patterns whose log odds stay above 2 at the lower
    end of a 90 % interval are kept; of a stem and its continuations the
    shortest that is as pure as the purest. All tables on the driver have a row
    per kept pattern or per class.
    """
    sample = written(sample)
    sizes = dict(sample.groupBy("y").count().collect())
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return Grammar({}, intercept=math.log((pos + 0.5) / (neg + 0.5)), slope=0.0)
    least = max(3, math.ceil(0.002 * pos))
    word, after = F.col("w.word"), F.col("w.after")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)
    patterns = F.array(F.concat(F.lit("="), word), *[
        F.when(F.length(word) >= n, F.substring(word, 1, n)) for n in STEMS])
    placed = (
        sample.where("y = 1").select(F.xxhash64("text").alias("doc"), words.alias("ws"))
        .select("doc", F.explode(F.array_distinct(F.arrays_zip(
            F.col("ws").alias("word"),
            F.concat(F.array(F.lit("")), F.col("ws")).alias("after")))).alias("w"))
        .where(word.isNotNull())
        .select("doc", F.xxhash64(after).alias("after"), F.explode(patterns).alias("pattern"))
        .where("pattern is not null"))
    per_doc = placed.select("pattern", "doc").distinct().groupBy("pattern").agg(
        F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= least)
    per_place = placed.select("pattern", "after").distinct().groupBy("pattern").agg(
        F.count(F.lit(1)).alias("places"))
    candidates = (per_doc.join(per_place, "pattern")
                  .select("pattern", F.least("docs", "places").alias("n"))
                  .where(F.col("n") >= least))
    support = {r["pattern"]: r["n"] for r in candidates.collect()}
    sent = sample.sparkSession.sparkContext.broadcast(frozenset(support))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, found = sent.value, {}
        for batch in batches:
            for text in batch["text"]:
                here = set()
                for w in set(re.findall(r"[^\W\d_]+", text.lower())):
                    here.add("=" + w)
                    here.update(w[:n] for n in STEMS if len(w) >= n)
                for p in here & wanted:
                    found[p] = found.get(p, 0) + 1
        if found:
            yield pd.DataFrame({"pattern": list(found), "n": list(found.values())})

    clean = {r["pattern"]: r["n"] for r in sample.where("y = 0").select("text").mapInPandas(
        count, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    grammar = Grammar(lexicon(support, clean, pos, neg))
    grammar.intercept, grammar.slope = _curve(sample, grammar)
    return grammar


def lexicon(support: dict[str, int], clean: dict[str, int], pos: int, neg: int
            ) -> dict[str, float]:
    """Weights of the patterns that set toxic texts apart."""
    odds, pure = {}, {}
    for p, n in support.items():
        m = clean.get(p, 0)
        middle = math.log((n + 0.5) / (pos + 1)) - math.log((m + 0.5) / (neg + 1))
        odds[p] = middle - 1.64 * math.sqrt(1 / (n + 0.5) + 1 / (m + 0.5))
        pure[p] = n / (n + m)
    kept = {p for p, v in odds.items() if v > 2.0}

    def longer(p: str) -> list[str]:
        if p.startswith("="):
            return []
        return [q for q in kept if q != p and (q.startswith(p) or q.startswith("=" + p))]

    # A stem is dropped if one continuation is purer and covers most of it ..
    chosen = {p for p in kept if not any(
        pure[q] >= pure[p] + 0.02 and support[q] >= 0.6 * support[p] for q in longer(p))}
    # .. and a continuation if a stem of it is as pure.
    for p in sorted(chosen, key=len):
        if p in chosen and not p.startswith("="):
            chosen -= {q for q in longer(p) if pure[q] <= pure[p] + 0.02}
    return {p: odds[p] for p in chosen}


def _curve(sample: DataFrame, grammar: Grammar, bins: int = 128) -> tuple[float, float]:
    """Intercept and slope of a ridge logistic curve over binned log weights."""
    sent = sample.sparkSession.sparkContext.broadcast(grammar)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.log1p([sent.value.weight(t) for t in batch["text"]])
            yield pd.DataFrame({"bin": np.minimum(bins - 1, np.rint(x * 16)).astype("int64"),
                                "y": batch["y"].astype("int64")})

    rows = (sample.mapInPandas(weigh, "bin long, y long").groupBy("bin", "y")
            .agg(F.count(F.lit(1)).alias("n")).collect())
    x = np.array([r["bin"] / 16 for r in rows])
    y, n = np.array([r["y"] for r in rows]), np.array([float(r["n"]) for r in rows])
    design = np.stack([np.ones_like(x), x], axis=1)
    beta, ridge = np.zeros(2), np.array([1e-3, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        gradient = design.T @ (n * (y - p)) - ridge * beta
        hessian = design.T @ (design * (n * p * (1 - p) + 1e-9)[:, None]) + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(0.0, beta[1]))


def score(docs: DataFrame, grammar: Grammar, *, text: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """Adds ``score`` (0 to 1), ``predicted``, ``weight`` and ``clauses`` to ``keep``.

    ``clauses`` is an array of the matched clauses and their weights. A name that
    ``keep`` has already gets ``_1`` after it. Null and
    empty texts have no clause and get the score of weight 0. Whole texts are
    read; rows are independent.
    """
    keep = keep if keep is not None else [c for c in docs.columns if c != text]
    sent = docs.sparkSession.sparkContext.broadcast(grammar)
    names = [own_name(keep, n) for n in ("score", "predicted", "weight", "clauses")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = sent.value
        for batch in batches:
            found = [g.clauses(t) for t in batch.pop("__text")]
            weights = [sum(w for _, w in c) for c in found]
            scores = [g.score(w) for w in weights]
            batch[names[0]] = scores
            batch[names[1]] = [int(x >= 0.5) for x in scores]
            batch[names[2]] = weights
            batch[names[3]] = [[{"clause": c, "weight": w} for c, w in f] for f in found]
            yield batch

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("__text")).mapInPandas(
        run, f"{kept}, `{names[0]}` double, `{names[1]}` int, `{names[2]}` double, "
             f"`{names[3]}` array<struct<clause:string,weight:double>>")


def reject(docs: DataFrame, grammar: Grammar, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores under 0.5, with all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text)).to_pylist()
            clean = batch.filter(pa.array([g.score(g.weight(t)) < 0.5 for t in texts]))
            if clean.num_rows:
                yield clean

    return docs.mapInArrow(run, docs.schema)


def train(docs: DataFrame, labels: DataFrame, held_out: Column,
          most: int = MAX_LABELLED) -> Grammar:
    """The grammar learned from the labelled documents not held out."""
    return learn(labelled(docs.select("doc_id", "text"), labels.where(~held_out), most))
