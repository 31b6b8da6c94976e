"""Qualified names: spellings, parts and the spelling that a server reads back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changerisk.functions.text import quote_identifier

_PART = r'"(?:[^"]|"")*"|[^."\s][^."]*'


def name_parts(name: Column) -> Column:
    """Parts of a spelled name as the server stores them, outermost first.

    Dots part a name outside of quotes only; unquoted parts are lower case,
    quoted ones stand as they are, a doubled quote for one.
    """
    return F.transform(F.regexp_extract_all(name, F.lit(f"({_PART})"), F.lit(1)), lambda p: F.when(
        p.startswith('"'), F.replace(F.substr(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))
    ).otherwise(F.lower(F.trim(p))))


def schema_part(name: Column) -> Column:
    """Schema of a spelled name, NULL for an unqualified one."""
    return F.try_element_at(name_parts(name), F.lit(-2))


def own_part(name: Column) -> Column:
    """The name itself without schema, as stored."""
    return F.try_element_at(name_parts(name), F.lit(-1))


def canonical(name: Column) -> Column:
    """The one spelling of a name: parts quoted where the server needs it, else in lower case.

    Relations are looked up by this spelling everywhere, so ``User``, ``user``
    and ``"user"`` are one name and ``"User"`` is another.
    """
    return F.array_join(F.transform(name_parts(name), quote_identifier), ".")


def last_spelled(name: Column) -> Column:
    """The last part of a canonical spelling, still spelled."""
    return F.regexp_extract(name, r'("(?:[^"]|"")*"|[^."]*)$', 1)
