"""Building blocks that keep one hot key from becoming one task.

``prefix_scan``       ordered state inside a key, computed chunk by chunk
``order_statistics``  exact medians and quantiles without collecting a group
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


CHUNK_ROWS = 1 << 16


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | str,
    columns: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Add, per row, a value folded over all earlier rows of its key.

    ``columns`` maps a new column to ``(how, expression)`` with ``how`` one of
    ``last`` (latest non-null), ``sum``, ``max`` and ``min``. ``chunk`` must
    never fall as ``order`` rises; naming an existing column lets
    several scans of one frame share its shuffle. Chunks of a key are folded in parallel, the
    chunk totals are scanned (one row per chunk), and each chunk is finished
    with what it carries in, so a key of any size is spread over many tasks
    and the input is shuffled once.
    """
    keys, order = list(keys), list(order)
    inputs = {name: f"__in_{name}" for name in columns}
    part = chunk if isinstance(chunk, str) else "__chunk"
    staged = df.select(
        "*", *([] if isinstance(chunk, str) else [chunk.alias(part)]),
        *[e.alias(inputs[n]) for n, (_, e) in columns.items()]
    )

    totals = []
    for name, (how, _) in columns.items():
        value = F.col(inputs[name])
        if how == "last":
            position = F.when(value.isNotNull(), F.struct(*order))
            totals.append(F.max_by(value, position).alias(f"__t_{name}"))
        else:
            totals.append(getattr(F, how)(value).alias(f"__t_{name}"))
    earlier_chunks = (W.partitionBy(*keys).orderBy(part)
                      .rowsBetween(W.unboundedPreceding, -1))
    carry = (
        staged.groupBy(*keys, part).agg(*totals)
        .select(*keys, part, *[
            _fold(how, F.col(f"__t_{n}")).over(earlier_chunks).alias(f"__c_{n}")
            for n, (how, _) in columns.items()
        ])
        .filter(reduce(or_, [F.col(f"__c_{n}").isNotNull() for n in columns]))
    )

    earlier_rows = (W.partitionBy(*keys, part).orderBy(*order)
                    .rowsBetween(W.unboundedPreceding, -1))
    joined = staged.join(carry, [*keys, part], "left").select(
        "*", *[_fold(how, F.col(inputs[n])).over(earlier_rows).alias(f"__w_{n}")
               for n, (how, _) in columns.items()]
    )
    results = []
    for name, (how, _) in columns.items():
        within, carried = F.col(f"__w_{name}"), F.col(f"__c_{name}")
        if how == "last":
            both = F.coalesce(within, carried)
        elif how == "sum":
            both = F.coalesce(within + carried, within, carried)
        elif how == "max":
            both = F.greatest(within, carried)
        else:
            both = F.least(within, carried)
        results.append(both.alias(name))
    return joined.select(*df.columns, *results)


def _fold(how: str, value: Column) -> Column:
    return F.last(value, ignorenulls=True) if how == "last" else getattr(F, how)(value)


#: Even cuts of a bucket that holds a wanted position.
_SLOTS = 1024


def _bucket(value: Column) -> Column:
    """A coarse bucket that never falls as the value rises (about 2000 exist)."""
    size = F.floor(F.log2(F.abs(value) + 1.0) * 16)
    return F.when(value < 0, -size).otherwise(size)


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, picks: dict[str, Column]
) -> DataFrame:
    """Exact values at given positions of each key's sorted values.

    ``picks`` maps an output column to a zero-based position written in terms
    of ``F.col("n")``, the number of non-null values of the key. Equal values
    are counted before the shuffle; bucket counts locate the bucket that holds
    each position, the counts of its slots the slot, and only those slots are
    sorted, so no task sorts a whole key. Returns ``keys``, ``n`` and the picked values.
    """
    keys = list(keys)
    counts = (df.filter(F.col(value).isNotNull())
              .groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__m"))
              .withColumn("__b", _bucket(F.col("__v"))))
    by_key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    buckets = (
        counts.groupBy(*keys, "__b").agg(F.sum("__m").alias("__bm"), F.min("__v").alias("__lo"),
                                         F.max("__v").alias("__hi"))
        .select(*keys, "__b", "__bm", "__lo", "__hi",
                F.sum("__bm").over(by_key).alias("n"),
                (F.sum("__bm").over(by_key.orderBy("__b")) - F.col("__bm")).alias("__before"))
    )
    position = {name: pick.cast("bigint") for name, pick in picks.items()}
    end = F.col("__before") + F.col("__bm")
    inside = F.lit(False)
    for pick in position.values():
        inside = inside | ((pick >= F.col("__before")) & (pick < end))
    # A logarithmic bucket may still hold all values of a key, say times of one
    # month, so the hit ones are cut again, evenly between their own ends.
    wanted = buckets.filter(inside)
    width = (F.col("__hi") - F.col("__lo")).cast("double")
    slot = F.when(width > 0, F.floor((F.col("__v") - F.col("__lo")).cast("double") / width
                                     * F.lit(float(_SLOTS)))).otherwise(F.lit(0)).cast("bigint")
    near = counts.join(wanted, [*keys, "__b"]).withColumn("__s", slot)
    by_slot = W.partitionBy(*keys, "__b").orderBy("__s")
    slots = (
        near.groupBy(*keys, "__b", "n", "__before", "__s").agg(F.sum("__m").alias("__bm"))
        .withColumn("__before", F.col("__before") + F.sum("__bm").over(by_slot) - F.col("__bm"))
        .filter(inside).select(*keys, "__b", "__s", F.col("__before").alias("__first")))
    in_slot = W.partitionBy(*keys, "__b", "__s").orderBy("__v")
    ranked = (
        near.join(slots, [*keys, "__b", "__s"])
        .withColumn("__end", F.col("__first") + F.sum("__m").over(in_slot))
        .withColumn("__start", F.col("__end") - F.col("__m"))
    )
    return ranked.groupBy(*keys, "n").agg(*[
        F.max(F.when((pick >= F.col("__start")) & (pick < F.col("__end")), F.col("__v")))
        .alias(name) for name, pick in position.items()
    ])


def medians(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact median per key: the mean of the two middle values."""
    n = F.col("n")
    found = order_statistics(df, keys, value,
                             {"lower": F.floor((n - 1) / 2), "upper": F.floor(n / 2)})
    middle = (F.col("lower").cast("double") + F.col("upper").cast("double")) / 2
    return found.select(*keys, "n", "lower", "upper", middle.alias("median"))
