"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line's tokens are the 64-bit hashes of its distinct five-word shingles (fewer
words: of the whole line). Under any order of tokens, two lines with Jaccard
similarity t or more share k of the first ``n - ceil(t * n) + k`` tokens of
each, or all that must agree if these are fewer. A first prefix, by hash, leaves
the lines that share so many tokens at all; among these tokens are ordered by
their exact rarity. Candidates must pass the length and the positional filter
and are then verified on all tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changerisk.llm.columns import own_name
from changerisk.llm.components import components
from changerisk.llm.scratch import Scratch

SHINGLE = 5
#: Similarity from which a line goes: 4/5.
SIMILARITY = (4, 5)
#: Tokens that two similar lines share in prefixes that are as many less one longer.
SHARED = 4
#: Words of the bit map that stands for the lines with a shared token.
FILTER_LONGS = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters between words, besides space.
BLANKS = "\t\n\x0b\x0c\r"
#: Lines of a posting that one row compares with a line.
BLOCK = 64


def line_words(line: Column) -> Column:
    """Words of a line: runs of anything but space and the control characters 9 to 13.

    Cut at single spaces, which needs no pattern; other blanks become spaces first.
    """
    odd = reduce(or_, [line.contains(c) for c in BLANKS])
    spaced = F.when(odd, F.translate(line, BLANKS, " " * len(BLANKS))).otherwise(line)
    return F.array_remove(F.split(spaced, " "), "")


def has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(" " + BLANKS)) != ""


def shingle_hashes(words: Column, shingle: int = SHINGLE) -> Column:
    """Sorted 64-bit hashes of the shingles, with repeats; fewer words make one."""
    def spread(ws: Column) -> Column:
        return F.when(F.size(ws) < shingle, F.array(F.xxhash64(ws))).otherwise(F.transform(
            F.sequence(F.lit(0), F.size(ws) - shingle),
            lambda i: F.xxhash64(*[F.get(ws, i + k if k else i) for k in range(shingle)])))

    # One lambda over a one-element array keeps the words from being computed per use.
    return F.sort_array(F.element_at(F.transform(F.array(words), spread), 1))


def line_tokens(words: Column, shingle: int = SHINGLE) -> Column:
    """Sorted distinct 64-bit hashes of the shingles; fewer words make one token."""
    return F.array_distinct(shingle_hashes(words, shingle))


def _fits(a: str, b: str, ratio: tuple[int, int]) -> Column:
    """Length and positional filter for a token at place i of n in both lines."""
    num, den = ratio
    least, most = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    reach = (F.least(f"{a}.i", f"{b}.i") + 1
             + F.least(F.col(f"{a}.n") - 1 - F.col(f"{a}.i"), F.col(f"{b}.n") - 1 - F.col(f"{b}.i")))
    return (least * den >= most * num) & (
        reach * (num + den) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * num)


def _similar(a: Column, b: Column, ratio: tuple[int, int]) -> Column:
    num, den = ratio
    return (F.size(F.array_intersect(a, b)) * (num + den)
            >= (F.size(a) + F.size(b)) * num)


class LineJoin:
    """The tables of one join over the lines of ``docs(key, text)``.

    ``first``: the first occurrence ``(key, pos)`` of every class of equal
    lines; ``matches``: ``(key, pos, match_key, match_pos)``, for every first
    occurrence that is similar to an earlier one, one such. The order is by
    key (null first), a hash of the text, and line number; rows with equal key
    and text share their lines' fate. Lines without words are left out. Classes
    are told apart by 128 bits of hash, tokens by 64.
    """

    def __init__(self, docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                 ratio: tuple[int, int] = SIMILARITY, shingle: int = SHINGLE):
        self.scratch = Scratch(docs.sparkSession)
        self.ratio, self.shingle = ratio, shingle
        self.docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        self.folded, path = self.scratch.keep(self._classes())
        self.first = self.folded.select("cls", "cls2", "key", "pos")
        self.matches, found = self.scratch.keep(self._matches())
        self.scratch.drop_all(path, found)

    def _lines(self) -> DataFrame:
        """All occurrences of lines with words: ``(key, pos, line, cls)``."""
        return (
            self.docs.select("key", position(F.col("text")).alias("th"),
                             F.posexplode(F.split("text", "\n")).alias("at", "line"))
            .where(has_word(F.col("line")))
            .select("key", (F.col("th") + F.col("at")).alias("pos"), "line",
                    F.xxhash64("line").alias("cls")))

    def _classes(self) -> DataFrame:
        """One row per class of equal lines: its first occurrence and its prefix by hash.

        Occurrences are folded before any token is a row of its own, so a line
        that a third of all rows hold is one line to the join.
        """
        num, den = self.ratio
        least = F.expr(f"(size(tokens) * {num} + {den - 1}) div {den}").cast("int")
        need = F.least(F.lit(SHARED), least)
        prefix = F.slice("tokens", 1, F.size("tokens") - least + need).alias("prefix")
        of_line = ["cls", "cls2", "f"]
        hashes = self._lines().select(
            "cls", F.xxhash64(F.lit(1), "line").alias("cls2"), F.struct("key", "pos").alias("f"),
            shingle_hashes(line_words(F.col("line")), self.shingle).alias("tokens"))
        # Where the prefix over all hashes holds no hash twice it covers the one
        # over distinct tokens, and as many of it are needed; elsewhere it is cut again.
        again = F.size(F.array_distinct("prefix")) < F.size("prefix")
        tokens = F.when(again, F.array_distinct("tokens")).otherwise(F.col("tokens"))
        return (
            hashes.select(*of_line, "tokens", prefix)
            .select(*of_line, tokens.alias("tokens"))
            .select(*of_line, need.alias("need"), prefix)
            .groupBy("cls", "cls2")
            .agg(F.min("f").alias("f"), F.first("need").alias("need"),
                 F.first("prefix").alias("prefix"))
            .select("cls", "cls2", "f.*", "need", "prefix"))

    def _postings(self) -> tuple[DataFrame, DataFrame]:
        """``_prefixes`` of the lines that share enough tokens, and ``(line, tokens)`` of these."""
        tokens_of = line_tokens(line_words(F.col("line")), self.shingle).alias("tokens")

        # A prefix under any fixed order finds all pairs, so the first one, over
        # all classes, is by hash: only lines that share SHARED tokens of it go on,
        # and among these rarity is counted exactly. One shuffle serves the count
        # and the join back: both read the same columns, so Spark reuses it.
        prefix = (
            self.folded.select("cls", "need", F.explode("prefix").alias("token"))
            .where("token is not null and cls is not null and need is not null")
            .repartition("token"))
        shared = (prefix.groupBy("token").agg(F.min("cls").alias("a"), F.max("cls").alias("b"),
                                              F.max("need").alias("need"))
                  .where("a <> b and need > 0").select("token"))
        members, _ = self.scratch.keep(
            prefix.join(shared.hint("shuffle_hash"), "token")
            .groupBy("token", "cls").agg(F.max("need").alias("need"))
            .groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
            .where("n >= need").select("cls"))

        # Whole token lists of those lines alone: a bit map of fixed size, at most
        # FILTER_LONGS rows, lets hardly any other line through, the join after it none.
        place = F.col("cls").bitwiseAND(F.lit(FILTER_LONGS * 64 - 1))
        word, bit = F.shiftright(place, 6), (place % 64).cast("int")
        bits = members.groupBy(word.alias("word")).agg(F.bit_or(F.call_function(
            "shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
        passed = F.call_function("shiftrightunsigned", F.col("bits"), bit).bitwiseAND(
            F.lit(1)) == 1
        marked = (self._lines().withColumn("word", word).join(F.broadcast(bits), "word")
                  .where(passed))
        spot = F.struct("key", "pos").alias("spot")
        wanted = members.join(self.first, "cls").select("cls", spot)
        lists, _ = self.scratch.keep(
            marked.select("cls", spot, "line").join(wanted, ["cls", "spot"])
            .dropDuplicates(["cls", "spot"]).select("cls", "spot", tokens_of))
        placed, _ = self.scratch.keep(self._prefixes(lists))
        tokens, _ = self.scratch.keep(
            lists.select(F.col("spot").alias("line"), "tokens")
            .join(placed.select("line").distinct(), "line", "left_semi"))
        return placed, tokens

    def _verified(self, pairs: DataFrame, tokens: DataFrame) -> DataFrame:
        """Those of ``pairs(line, match)`` that are similar by all tokens."""
        return (
            pairs.join(tokens, "line")
            .join(tokens.select(F.col("line").alias("match"), F.col("tokens").alias("others")),
                  "match")
            .where(_similar(F.col("tokens"), F.col("others"), self.ratio))
            .select("line", "match"))

    def _with_earliest(self, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The earliest line of every posting, and it paired with the others that may match."""
        earliest = placed.groupBy("token").agg(
            F.min(F.struct("line", "n", "i")).alias("p"), F.count(F.lit(1)).alias("members"))
        pairs = (placed.alias("x").join(earliest.select("token", "p.*").alias("p"), "token")
                 .where((F.col("x.line") > F.col("p.line")) & _fits("x", "p", self.ratio))
                 .select(F.col("x.line").alias("line"), F.col("p.line").alias("match")).distinct())
        return earliest, pairs

    def _matches(self) -> DataFrame:
        placed, tokens = self._postings()

        # First the earliest line of every posting against the others: of copies
        # with small changes nearly all go here, by as many comparisons as members.
        earliest, pairs = self._with_earliest(placed)
        found, _ = self.scratch.keep(self._verified(pairs, tokens)
                                     .groupBy("line").agg(F.min("match").alias("match")))

        # Then each line still kept against all earlier ones but the first, a
        # posting's lines dealt into blocks by hash.
        rest = self._dealt(placed, earliest)
        later = rest.join(found.select("line"), "line", "left_anti")
        open_tokens = later.select("token").distinct()
        held = rest.join(open_tokens, "token", "left_semi")
        more = (self._in_blocks(later, held, tokens)
                .select("line", F.array_min(F.transform("similar", lambda y: y["line"]))
                        .alias("match"))
                .where("match is not null").groupBy("line").agg(F.min("match").alias("match")))
        return found.unionByName(more).select(
            "line.*", F.col("match.key").alias("match_key"), F.col("match.pos").alias("match_pos"))

    def _dealt(self, placed: DataFrame, earliest: DataFrame) -> DataFrame:
        """``placed`` without the earliest line of every posting, and the blocks of the posting."""
        return (placed.join(earliest.where("members > 2").select(
                    "token", F.col("p.line").alias("pivot"), "members"), "token")
                .where(F.col("line") != F.col("pivot"))
                .withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")))

    def _in_blocks(self, asked: DataFrame, held: DataFrame, tokens: DataFrame,
                   part: str | None = None) -> DataFrame:
        """Every line of ``asked`` with each block of ``held`` lines of its posting.

        ``similar`` has those of the block that are earlier and similar; with
        ``part`` only such as differ in that column.
        """
        num, den = self.ratio
        also = [part] if part else []
        blocks = (held.join(tokens, "line")
                  .groupBy("token", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int")
                           .alias("block"))
                  .agg(F.collect_list(F.struct("line", "n", "i", "tokens", *also))
                       .alias("others")))
        spread = (asked.join(tokens, "line")
                  .select("token", "line", "n", "i", "tokens", *also, F.explode(F.sequence(
                      F.lit(0), F.col("blocks") - 1)).alias("block")))

        def matching(y: Column) -> Column:
            least, most = F.least("n", y["n"]), F.greatest("n", y["n"])
            reach = (F.least("i", y["i"]) + 1
                     + F.least(F.col("n") - 1 - F.col("i"), y["n"] - 1 - y["i"]))
            apart = F.col(part) != y[part] if part else F.lit(True)
            return (apart & (y["line"] < F.col("line")) & (least * den >= most * num)
                    & (reach * (num + den) >= (F.col("n") + y["n"]) * num)
                    & _similar(F.col("tokens"), y["tokens"], self.ratio))

        return spread.join(blocks, ["token", "block"]).select(
            "line", F.filter("others", matching).alias("similar"))

    def _prefixes(self, lists: DataFrame) -> DataFrame:
        """Postings ``(token, line, n, i)`` of the lines that can still have a match.

        Among these lines rarity is exact: tokens are counted, and those of one
        line alone are known. A line needs ``t * n`` tokens that others have,
        too; its prefix begins with those that none has.
        """
        num, den = self.ratio
        spread = (lists.select("cls", F.size("tokens").alias("n"), F.explode("tokens")
                               .alias("token"))
                  .where("token is not null and cls is not null and n is not null")
                  .repartition("token"))
        often = (spread.groupBy("token").agg(F.count(F.lit(1)).alias("df"),
                                             F.max("cls").alias("cls"), F.max("n").alias("n"))
                 .where("df > 1 and cls is not null and n > 0").select("token", "df"))
        of_line = Window.partitionBy("cls")
        least = F.expr(f"(n * {num} + {den - 1}) div {den}").cast("int")
        ranked = (
            spread.join(often.hint("shuffle_hash"), "token")
            .withColumn("at", F.row_number().over(of_line.orderBy("df", "token")))
            .withColumn("r", F.count(F.lit(1)).over(of_line).cast("int"))
            .where((F.col("r") >= least) & (F.col("at") <= F.col("r") - least + 1)))
        return (ranked.join(lists.select("cls", F.col("spot").alias("line")), "cls")
                .select("token", "line", "n", (F.col("n") - F.col("r") + F.col("at") - 1)
                        .alias("i")))


class TextJoin(LineJoin):
    """The same join over whole texts, each as one line: links instead of matches.

    Words are those of a line, A-Z count as a-z. ``first`` has a row per class
    of texts with equal words, ``matches`` links ``(a, b)`` between ``(key,
    pos)`` of these, whose components are those over all similar pairs.
    ``candidates(first)`` gives pairs ``(line, match)`` of such spots. They are
    verified first; the postings only link what these leave apart.
    """

    def __init__(self, docs: DataFrame, candidates: Callable[[DataFrame], DataFrame],
                 **settings):
        self.candidates = candidates
        super().__init__(docs, **settings)

    def _lines(self) -> DataFrame:
        words = line_words(F.translate("text", UPPER, LOWER))
        return (self.docs.select("key", position(F.col("text")).alias("pos"),
                                 F.xxhash64("text").alias("tie"), F.array_join(words, " ").alias("line"))
                .where("line <> ''").withColumn("cls", F.xxhash64("line")))

    def _named(self, links: DataFrame) -> DataFrame:
        """``(node, component)`` over ``links(line, match)``."""
        return self.scratch.keep(components(links.select(F.col("line").alias("a"),
                                                         F.col("match").alias("b"))))[0]

    def _matches(self) -> DataFrame:
        placed, tokens = self._postings()

        # Texts that are in no posting are similar to none, so they have no tokens here.
        close, _ = self.scratch.keep(self._verified(self.candidates(self.first), tokens))
        named = self._named(close)
        earliest, pairs = self._with_earliest(placed)
        for end in ("line", "match"):
            pairs = pairs.join(named.select(F.col("node").alias(end),
                                            F.col("component").alias(f"{end}_part")), end, "left")
        pairs = pairs.where(F.coalesce("line_part", "line") != F.coalesce("match_part", "match"))
        found, _ = self.scratch.keep(self._verified(pairs.select("line", "match"), tokens)
                                     .unionByName(close))

        # Of the others only those are compared that these links do not connect yet, in
        # blocks: unlike texts that share a passage are no row for each two of them. A
        # text is linked to the part of what it resembles, which names one of its spots.
        named = self._named(found)
        rest, _ = self.scratch.keep(
            self._dealt(placed, earliest)
            .join(named.withColumnRenamed("node", "line"), "line", "left")
            .select("token", "line", "n", "i", "blocks",
                    F.coalesce("component", "line").alias("part")))
        apart = rest.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")
                                          ).where("lo <> hi").select("token")
        rest = rest.join(apart, "token", "left_semi")
        more = (self._in_blocks(rest, rest, tokens, part="part")
                .select("line", F.explode(F.array_distinct(F.transform(
                    "similar", lambda y: y["part"]))).alias("match")).distinct())
        return found.unionByName(more).select(F.col("line").alias("a"), F.col("match").alias("b"))

    def parts(self) -> DataFrame:
        """``(cls, cls2, part)``: the component of every class, named by one of its spots."""
        named = components(self.matches).withColumnRenamed("node", "spot")
        spots = self.first.select("cls", "cls2", F.struct("key", "pos").alias("spot"))
        return spots.join(named, "spot", "left").select(
            "cls", "cls2", F.coalesce("component", "spot").alias("part"))

    def classes(self) -> DataFrame:
        """``(key, tie, cls, cls2)`` of every text with words; ``tie`` is a hash of the text."""
        return self._lines().select("key", "tie", "cls",
                                    F.xxhash64(F.lit(1), "line").alias("cls2"))


def position(text: Column) -> Column:
    """Base of a text's line positions: 31 bits of its hash above 32 bits of line number."""
    return F.shiftleft(F.xxhash64(text).bitwiseAND(F.lit((1 << 31) - 1)), 32)


def remove_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                 ratio: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``docs`` with later matches of lines removed, and four counts.

    A line goes if an earlier line of the table equals it, or has a token set
    with Jaccard similarity ``ratio`` or more; whether that one stays itself
    makes no difference. Lines without words always stay. Adds ``n_lines``,
    ``n_kept``, ``n_equal`` (gone because equal) and ``n_similar`` (gone because
    similar only); if the input has such a name already, the new column gets
    ``_1`` after it. A null text stays null with counts 0, an empty one has one
    line. Documents that lose all lines stay, with an empty text. Order and the
    fate of repeated rows are those of ``LineJoin``. An empty table gives an
    empty one.
    """
    join = LineJoin(docs, key=key, text=text, ratio=ratio)
    near = join.matches.select(F.struct("key", "pos").alias("spot"), F.lit(True).alias("near"))
    line_no = F.col("spot.pos").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    firsts = (
        join.first.select(F.struct("key", "pos").alias("spot")).join(near, "spot", "left")
        .groupBy(F.col("spot.key").alias("__k"), F.shiftright("spot.pos", 32).alias("__t"))
        .agg(F.collect_list(F.when(F.col("near").isNull(), line_no)).alias("__stay"),
             F.count("near").alias("__similar")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text],
                                F.lit(0).alias("__pad")).alias("__doc"),
                       F.col(key).alias("__key"), F.col(text).alias("__text"))
    joined = rows.join(firsts, F.col("__key").eqNullSafe(F.col("__k"))
                       & (F.shiftright(position(F.col("__text")), 32) == F.col("__t")), "left")
    lines = joined.select(
        "__doc", F.split("__text", "\n").alias("__lines"), "__similar",
        F.coalesce("__stay", F.array().cast("array<int>")).alias("__stay"))
    blank = F.filter(F.sequence(F.lit(0), F.size("__lines") - 1),
                     lambda i: ~has_word(F.get(F.col("__lines"), i)))
    kept = lines.select("__doc", "__lines", "__similar",
                        F.sort_array(F.array_union("__stay", blank)).alias("__kept"))
    made = F.array_join(F.transform("__kept", lambda i: F.get(F.col("__lines"), i)), "\n")
    none = F.lit(0).cast("long")
    counts = {"n_lines": F.size("__lines").cast("long"), "n_kept": F.size("__kept").cast("long"),
              "n_equal": F.size("__lines") - F.size("__kept") - F.coalesce("__similar", none),
              "n_similar": F.coalesce("__similar", none)}
    there = F.col("__lines").isNotNull()
    return kept.select(
        *[F.when(there, made).alias(c) if c == text else F.col(f"__doc.`{c}`").alias(c)
          for c in docs.columns],
        *[F.when(there, v).otherwise(none).alias(own_name(docs, c)) for c, v in counts.items()])
