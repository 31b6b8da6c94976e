"""Sharding along a Hilbert curve over several columns.

Every column is quantised to a few bits, the cells get their place on the
curve, and runs of the order are cut into shards of equal row counts. A shard
then covers a compact region of all columns, so readers skip most of them by
the ranges in the manifest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changerisk.llm.columns import own_name
from changerisk.llm.scratch import written

#: Rows of one cell are counted and ordered in this many parts.
PARTS = 256


def octave(value: Column) -> Column:
    """Cell of a number of 0 or more: the place of its highest bit. Null is cell 0."""
    return F.coalesce(F.length(F.bin(F.greatest(value.cast("long"), F.lit(0)))), F.lit(0))


def category(value: Column, bits: int) -> Column:
    """Cell of a value without an order, by its hash; null has a cell like any value."""
    return F.pmod(F.xxhash64(value), F.lit(1 << bits)).cast("int")


def curve_places(cells: list[np.ndarray], bits: int) -> np.ndarray:
    """Places on the Hilbert curve through the grid with ``2**bits`` cells a side.

    John Skilling's transform ("Programming the Hilbert curve", 2004), on
    whole arrays: undo the excess rotations from the highest bit down, take
    the Gray code, and interleave the bits of all dimensions.
    """
    x = [np.asarray(c, dtype=np.int64).copy() for c in cells]
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flips ^= np.where((x[n - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | (((x[i] ^ flips) >> b) & 1)
    return place


def shard(df: DataFrame, cells: dict[str, Column], shards: int, *, bits: int = 5,
          tie: list[Column], carry: list[Column]) -> DataFrame:
    """Shards whose row counts differ by one at most.

    Returns ``carry`` and ``curve`` (place of the row's cell), ``shard`` (0 to
    ``shards`` - 1) and ``slot`` (0 upwards inside the shard). ``cells`` are
    integer columns, cut to 0 .. ``2**bits - 1``, null as 0; ``bits`` times
    their number must stay under 18. Rows of one cell are ordered by a hash of
    ``tie`` and then by ``tie``; rows equal in all of it are interchangeable.

    Places are counted, not sorted globally: counts per (cell, part) give every
    part its first rank, with windows over at most ``2**(bits * columns)``
    cells and PARTS parts, and only the rows of one part are sorted together.
    An empty table gives an empty one. A name that ``carry`` has already gets
    ``_1`` after it.
    """
    if bits * len(cells) > 17:
        raise ValueError("too many cells to count: lower bits")

    @F.pandas_udf(T.IntegerType())
    def place(grid: pd.DataFrame) -> pd.Series:
        return pd.Series(curve_places([grid[c].to_numpy() for c in grid], bits).astype(np.int32))

    grid = F.struct(*[
        F.least(F.greatest(F.coalesce(c.cast("int"), F.lit(0)), F.lit(0)),
                F.lit((1 << bits) - 1)).alias(f"c{i}") for i, c in enumerate(cells.values())])
    rows = written(df.select(
        F.struct(*carry).alias("__row"), F.struct(*tie).alias("__tie"),
        F.pmod(F.xxhash64(*tie), F.lit(PARTS)).cast("int").alias("__part"),
        place(grid).alias("curve")))
    parts = rows.groupBy("curve", "__part").agg(F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy().orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        parts.groupBy("curve").agg(F.sum("__n").alias("__n"))
        .select("curve", F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__first"),
                F.sum("__n").over(Window.partitionBy()).alias("__total")))
    in_cell = (Window.partitionBy("curve").orderBy("__part")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (
        parts.withColumn("__offset", F.coalesce(F.sum("__n").over(in_cell), F.lit(0)))
        .join(starts, "curve")
        .select("curve", "__part", "__total", (F.col("__first") + F.col("__offset"))
                .alias("__base")))
    in_part = Window.partitionBy("curve", "__part").orderBy("__tie")
    total, rank = F.col("__total"), F.col("__rank")
    cut = F.expr(f"__rank * {shards} div __total")
    taken = rows.select("__row.*").columns
    return (
        rows.join(offsets, ["curve", "__part"])
        .withColumn("__rank", F.col("__base") + F.row_number().over(in_part) - 1)
        .select("__row.*", F.col("curve").alias(own_name(taken, "curve")),
                cut.cast("int").alias(own_name(taken, "shard")),
                (rank - F.ceil(cut * total / shards)).cast("long")
                .alias(own_name(taken, "slot")))
    )


def manifest(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """One row per shard: its rows and the range of every column, for skipping files."""
    return sharded.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(F.col(c)).alias(f"{c}_{name}") for c in columns
          for f, name in ((F.min, "min"), (F.max, "max"))])


def write_shards(sharded: DataFrame, path: str) -> None:
    """Parquet files, one folder per shard, rows in curve order inside."""
    (sharded.repartition("shard").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
