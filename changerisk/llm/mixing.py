"""Mixing sources to target weights by distributed prefix sums.

Every document gets a random key that only its id decides. Within a source
the documents are ordered by that key and their sizes are summed up; the
source's budget cuts that order at one place. Budgets above the source's size
take whole passes over it first.

The order is never sorted in one place: the first hexadecimal digits of the
key cut it into 4096 ranges, ranges are summed before any shuffle, and running
sums are taken over at most 4096 range totals and, apart from that, inside one
range of one source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changerisk.llm.columns import own_name, word_count
from changerisk.llm.scratch import written

#: Hexadecimal digits of the key that name its range: 16**3 ranges of a source.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3),
                   most: int = 3) -> DataFrame:
    """Words to take from every source: ``(source, source_size, target)``.

    ``sizes(source, size)``. Sources in code point order, null last, weigh
    ``weights`` in turn. They share the sum of all sizes; a target stops at
    ``most`` times its source's size, and what is above is shared again by
    weight until no target is above. That ends at one level L: the target is
    ``min(most * size, weight * L)``. Sources sorted by ``most * size /
    weight`` reach their bound in this order, so L follows from running sums.
    The windows run over one row per source. Without any words all targets are 0.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.col("__nth") - 1) % len(weights) + 1).cast("int"))
    all_rows = Window.partitionBy()
    by_ratio = all_rows.orderBy("__ratio", "__nth")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
        .withColumn("__nth", F.row_number().over(
            all_rows.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("__weight", weight)
        .withColumn("__bound", (F.col("source_size") * most).cast("double"))
        .withColumn("__ratio", F.col("__bound") / F.col("__weight")))
    levels = (
        totals
        .withColumn("__left", F.sum("source_size").over(all_rows).cast("double")
                    - F.coalesce(F.sum("__bound").over(before), F.lit(0.0)))
        .withColumn("__weights", F.sum("__weight").over(all_rows)
                    - F.coalesce(F.sum("__weight").over(before), F.lit(0.0)))
        .withColumn("__level", F.col("__left") / F.col("__weights"))
        .withColumn("__place", F.row_number().over(by_ratio)))
    first = F.min(F.when(F.col("__ratio") >= F.col("__level"),
                         F.struct("__place", "__level"))).over(all_rows)
    level = first["__level"]
    return levels.select(
        "source", "source_size",
        F.when(F.col("__ratio") < level, F.col("__bound"))
        .otherwise(F.col("__weight") * level).alias("target"))


def mix(docs: DataFrame, *, size: Column | None = None, key: str = "doc_id",
        text: str = "text", source: str = "source", carry: list[str] | None = None,
        weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """What the mix takes of every document.

    Returns ``carry`` (the key column if not given) and ``size``,
    ``source_size``, ``target``, ``taken`` (words, repeats counted; the words
    of a source add up to its target cut to a whole number) and ``passes``
    (how often the document is read: whole passes, and once more if the last,
    cut pass reaches its place). ``size`` defaults to the number of words.

    Null texts have size 0, null sources are one source, null keys count as
    the empty key. Rows with equal keys are ordered by size, so equal rows get
    the same multiset of results whatever their order. An empty table gives an
    empty one. Columns of the input other than those named are not read. A name
    that ``carry`` has already gets ``_1`` after it.
    """
    carry = carry if carry is not None else [key]
    sized = written(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("__row"), F.col(source).alias("source"),
        F.coalesce(size if size is not None else word_count(F.col(text)),
                   F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("__key"))
        .withColumn("__range", F.substring("__key", 1, RANGE_DIGITS)))
    ranges = sized.groupBy("source", "__range").agg(F.sum("size").alias("size"))
    starts = ranges.withColumn("__start", F.coalesce(F.sum("size").over(
        Window.partitionBy("source").orderBy("__range")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    targets = source_targets(ranges.select("source", "size"), weights, most)
    plan = starts.alias("r").join(
        targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select(
        F.col("r.source").alias("source"), "__range", "__start", "source_size", "target")
    inside = (Window.partitionBy("d.source", "d.__range").orderBy("__key", "d.size")
              .rowsBetween(Window.unboundedPreceding, -1))
    whole = F.when(F.col("source_size") > 0,
                   F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return (
        sized.alias("d").join(plan.alias("p"),
                              F.col("d.source").eqNullSafe(F.col("p.source"))
                              & (F.col("d.__range") == F.col("p.__range")))
        .withColumn("__before", F.col("__start")
                    + F.coalesce(F.sum("d.size").over(inside), F.lit(0)))
        .withColumn("__whole", whole.cast("long"))
        .withColumn("__rest", F.floor("target") - F.col("__whole") * F.col("source_size"))
        .select(
            "__row.*", F.col("d.size").alias(own_name(carry, "size")),
            F.col("source_size").alias(own_name(carry, "source_size")),
            F.col("target").alias(own_name(carry, "target")),
            (F.col("__whole") * F.col("d.size") + F.greatest(F.lit(0), F.least(
                F.col("d.size"), F.col("__rest") - F.col("__before"))))
            .alias(own_name(carry, "taken")),
            (F.col("__whole") + (F.col("__before") < F.col("__rest")).cast("long"))
            .alias(own_name(carry, "passes"))))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mixed table: every document as often as the mix reads it.

    A document at the cut is not shortened, so a source's words may exceed its
    target by less than that document. Columns and names are those of ``docs``.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    key, text, source = (options.pop(k, v) for k, v in
                         (("key", "doc_id"), ("text", "text"), ("source", "source")))
    packed = docs.select(whole.alias("__doc"), F.col(key).alias("__id"),
                         F.col(source).alias("__source"),
                         word_count(F.col(text)).alias("__size"))
    mixed = mix(packed, size=F.col("__size"), key="__id", source="__source", carry=["__doc"],
                **options)
    return (mixed.where("passes > 0")
            .select("__doc", F.explode(F.sequence(F.lit(1), F.col("passes").cast("int"))))
            .select("__doc.*"))
