"""Sharing a computed value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    Inside a lambda there is no earlier projection to hold a shared value, and
    repeating a costly expression would evaluate it at every use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def record(**fields: Column) -> Column:
    """A struct whose field names hold however its values are typed."""
    return F.named_struct(*[part for name, value in fields.items()
                            for part in (F.lit(name), value)])
