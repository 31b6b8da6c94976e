"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def constants(values: list[int], kind: str) -> Column:
    """A list of numbers as one constant of the plan, whatever its length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def held_out(key: Column) -> Column:
    """Whether a row is kept out of learning; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def own_name(df: DataFrame | list[str], wanted: str) -> str:
    """``wanted``, or the first ``wanted_1``, ``wanted_2`` .. that no column has.

    Columns of the input keep their names; an operator's own give way.
    """
    taken = {c.lower() for c in (df if isinstance(df, list) else df.columns)}
    name, n = wanted, 0
    while name.lower() in taken:
        n += 1
        name = f"{wanted}_{n}"
    return name
