"""Facts: values that may be missing for a stated reason.

A fact is ``struct<available, value, reason>``. A NULL value inside an
available fact is a known state and differs from an unavailable fact, so the
two are never collapsed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changerisk.functions.binding import record


def known(value: Column) -> Column:
    return record(available=F.lit(True), value=value, reason=F.lit(None).cast("string"))


def unavailable(reason: Column, type_: str) -> Column:
    return record(available=F.lit(False), value=F.lit(None).cast(type_), reason=reason)


def fact(ok: Column, value: Column, reason: Column, type_: str) -> Column:
    """A fact known where ``ok`` holds, else unavailable for ``reason``."""
    ok = F.coalesce(ok, F.lit(False))
    return record(available=ok, value=F.when(ok, value.cast(type_)),
                  reason=F.when(~ok, reason))


def has(column: Column) -> Column:
    """True when the fact is present and available (NULL facts are not)."""
    return F.coalesce(column["available"], F.lit(False))


def has_value(column: Column) -> Column:
    """True when the fact is available and its value is not NULL."""
    return has(column) & column["value"].isNotNull()
