"""Volatility of default expressions from the functions they call."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changerisk.functions.binding import let
from changerisk.seeds import literal_map, tables

# Syntax that looks like a call but adds no volatility of its own.
_SYNTAX_WORDS = ("coalesce", "nullif", "row", "and", "or", "not", "in", "case", "when", "then",
                 "else", "cast", "array", "between", "is", "any", "all", "values")
_VALUE_WORDS = r"(?i)\b(current_timestamp|current_date|current_time|localtimestamp|localtime|" \
               r"current_user|session_user|current_role|current_catalog|current_schema|user)\b"
_CONSTANT = r"(?i)^\s*(?:[+-]?\d+(?:\.\d+)?(?:e[+-]?\d+)?|[bexn]?''|true|false|null)" \
            r"(?:\s*::\s*[a-z_][a-z0-9_ ]*(?:\([\d, ]*\))?(?:\[\])*)?\s*$"


def _bare(expression: Column) -> Column:
    """The expression without the contents of its string literals."""
    return F.regexp_replace(expression, r"'(?:[^']|'')*'", "''")


def _calls(expression: Column) -> Column:
    """Dotted lower-case names of the called functions, casts left out."""
    uncast = F.regexp_replace(_bare(expression), r"(?i)::\s*[a-z_][a-z0-9_ ]*(\([\d, ]*\))?", " ")
    names = F.regexp_extract_all(F.lower(uncast),
                                 F.lit(r"([a-z_][a-z0-9_$]*(?:\.[a-z_][a-z0-9_$]*)*)\s*\("),
                                 F.lit(1))
    return F.filter(names, lambda n: ~n.isin(*_SYNTAX_WORDS))


def _static_rank(name: Column) -> Column:
    known = literal_map({row["name"]: row["rank"] for row in tables.volatility_rows()})
    return F.coalesce(F.try_element_at(known, F.substring_index(name, ".", -1)), F.lit(3))


def unknown_functions(expression: Column) -> Column:
    """Sorted distinct names the dictionary cannot decide."""
    return F.array_sort(F.array_distinct(
        F.filter(_calls(expression), lambda n: _static_rank(n) == 3)))


def _unknown_operator(expression: Column) -> Column:
    symbols = F.regexp_extract_all(
        F.regexp_replace(_bare(expression), r"::", " "),
        F.lit(r"([+\-*/<>=~!@#%^&|?]+)"), F.lit(1))
    # a sign after an operator (``- -1``) is not part of it
    known = F.array(*[F.lit(o) for o in tables.KNOWN_OPERATORS])
    return F.exists(symbols, lambda s: ~F.array_contains(known, s)
                    & ~F.array_contains(known, F.regexp_replace(s, r"(?<=.)[+-]$", "")))


def volatility_rank(expression: Column, live: Column | None = None) -> Column:
    """Rank of the worst part: 0 constant .. 2 stable, 3 unknown, 4 volatile.

    ``live`` maps function names to rank facts; they decide only what the
    dictionary leaves unknown.
    """
    def rank(name: Column) -> Column:
        if live is None:
            return _static_rank(name)
        return let(_static_rank(name), lambda static: F.when(static != 3, static).otherwise(
            F.coalesce(F.try_element_at(live, name), F.lit(3))))

    def worst(bare: Column) -> Column:
        return F.when(bare.isNull() | bare.rlike(_CONSTANT), F.lit(0)).otherwise(F.greatest(
            F.lit(1), F.array_max(F.transform(_calls(bare), rank)),
            F.when(bare.rlike(_VALUE_WORDS), F.lit(2)),
            F.when(bare.rlike(r"(?i)\bselect\b") | _unknown_operator(bare), F.lit(3))))

    return let(_bare(expression), worst)


def volatility_name(rank: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(n) for n in tables.VOLATILITY_RANK]),
                            (rank + 1).cast("int"))


def decide_volatility(static: Column, expression: Column, live: Column) -> Column:
    """The default's volatility with live facts; a decided static answer stays."""
    answered = F.exists(unknown_functions(expression),
                        lambda n: F.try_element_at(live, n).isNotNull())
    return F.when((static != "unknown") | expression.isNull() | ~answered, static).otherwise(
        volatility_name(volatility_rank(expression, live)))
