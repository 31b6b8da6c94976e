"""Narrowing: what catalog facts say about an ALTER TABLE action.

A rule marked ``live`` is a worst case. Each function here reads the facts
joined to the action's row and returns a ``narrow`` struct:

``outcome``   constant, proportional, keep_model or unresolved
``method``    evidence class; unresolved outcomes are unverified
``reason``    why, in words
``condition`` what must hold for the cheap branch, NULL when nothing must
``extra_relation``, ``extra_level``  a further lock the facts reveal
``family``    rate family replacing the kind's own
``relabel``   the type change keeps every stored value
``rebuilds``  rate families of the indexes that must be rebuilt
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changerisk.functions.binding import let
from changerisk.functions.facts import has, has_value
from changerisk.functions.text import proves_not_null
from changerisk.functions.types import assess_type_change
from changerisk.functions.volatility import decide_volatility

_ROW_SHARE, _ACCESS_EXCLUSIVE = 2, 8


def _result(outcome: str, reason: Column | str, *, condition: str | None = None,
            extra_relation: Column | None = None, extra_level: int | None = None,
            family: str | None = None, relabel: bool = False,
            rebuilds: Column | None = None, method: Column | None = None) -> Column:
    evidence = "unverified" if outcome == "unresolved" else "observed"
    nothing = "cast(NULL AS string)"

    def text(value: str | None) -> str:
        return nothing if value is None else "'" + value.replace("'", "\\'") + "'"

    # one parsed expression; the few computed fields replace their constants
    out = F.expr(
        f"named_struct('outcome', {text(outcome)}, 'method', {text(evidence)}, 'reason', "
        f"{text(reason if isinstance(reason, str) else None)}, 'condition', {text(condition)}, "
        f"'extra_relation', {nothing}, 'extra_level', cast(NULL AS int), "
        f"'family', {text(family)}, 'relabel', {str(relabel).lower()}, "
        "'rebuilds', cast(array() AS array<string>))")
    if not isinstance(reason, str):
        out = out.withField("reason", reason)
    if method is not None:
        out = out.withField("method", method)
    if extra_relation is not None:
        out = out.withField("extra_relation", extra_relation).withField(
            "extra_level", F.when(extra_relation.isNotNull(), F.lit(extra_level)))
    return out if rebuilds is None else out.withField("rebuilds", rebuilds)


def add_column_domain(action: Column, type_facts: Column) -> Column:
    """A default on a domain with checks rewrites the table, otherwise it is stored once."""
    constraints, not_null = type_facts["domain_constraint_count"], type_facts["domain_not_null"]
    checked = (F.coalesce(constraints["value"], F.lit(0)) > 0) | F.coalesce(
        not_null["value"], F.lit(False))
    return (
        F.when(action["column_type"].isNull(), _result("unresolved", "no column type is recorded"))
        .when(type_facts.isNull(), _result("unresolved", "type facts were not captured"))
        .when(~has(type_facts["is_domain"]),
              _result("unresolved", "whether the type is a domain is unknown"))
        .when(type_facts["is_domain"]["value"] == F.lit(False),
              _result("constant", "the type is not a domain: the default is stored once"))
        .when(~has(constraints) | ~has(not_null),
              _result("unresolved", "the domain's constraints could not be read"))
        .when(checked, _result("proportional", "the domain checks every row: a rewrite"))
        .otherwise(_result("constant", "the domain has no constraints"))
    )


def add_column_unknown_volatility(action: Column, type_facts: Column, live: Column) -> Column:
    """Function facts decide the default's volatility, then the domain question remains."""
    decided = decide_volatility(action["default_volatility"], action["default_expression"], live)
    return (
        F.when(action["default_expression"].isNull() & action["default_volatility"].isNull(),
               _result("unresolved", "no default expression is recorded"))
        .when(decided == "unknown", _result("unresolved", "the default's volatility is undecided"))
        .when(decided == "volatile",
              _result("proportional", "a volatile default is evaluated for every row"))
        .otherwise(add_column_domain(action, type_facts))
    )


def rebuilt_indexes(facts: Column, column: Column) -> Column:
    """Indexes on the column that a type change without rewrite must still rebuild."""
    return F.filter(
        facts["indexes"]["value"],
        lambda ix: F.array_contains(ix["depends_on"], F.coalesce(column, F.lit("")))
        & (ix["partial"] | ix["has_expressions"] | (ix["method"] != "btree")
           | ~ix["default_opclasses"]))


def no_rewrite_with_indexes(facts: Column, column: Column) -> Column:
    """A skipped rewrite still rebuilds the column's partial, expression and odd indexes."""
    unknown = (facts.isNull() | ~has(facts["exists"]) | (facts["exists"]["value"] == F.lit(False))
               | ~has_value(facts["indexes"]))
    families = F.transform(
        rebuilt_indexes(facts, column),
        lambda ix: F.when(ix["has_expressions"] | (ix["method"] != "btree"),
                          "index_build_expression").otherwise("index_build_btree"))
    return let(families, lambda f: _rebuild_result(unknown, f))


def _rebuild_result(unknown: Column, families: Column) -> Column:
    return (
        F.when(unknown, _result("unresolved", "no rewrite, but the dependent indexes are unknown"))
        .when(F.size(families) == 0,
              _result("constant", "no table rewrite and no index rebuild", relabel=True))
        .otherwise(_result("proportional", "no table rewrite, but indexes are rebuilt",
                           relabel=True, rebuilds=families))
    )


def alter_column_type(action: Column, facts: Column, change: Column, pg_version: Column,
                      target: Column) -> Column:
    judged = assess_type_change(change, action["column_type"], action["has_using"], pg_version)
    return let(judged, lambda j: _type_change_result(action, facts, change, target, j))


def _type_change_result(action: Column, facts: Column, change: Column, target: Column,
                        judged: Column) -> Column:
    return (
        F.when(target.isNull() | action["column"].isNull() | action["column_type"].isNull(),
               _result("unresolved", "the relation, column or new type is not recorded"))
        .when(change.isNull(), _result("unresolved", "type-change facts were not captured"))
        .when(judged["outcome"] == "no_rewrite", no_rewrite_with_indexes(facts, action["column"]))
        .when(judged["outcome"] == "no_rewrite_if_utc", _result(
            "proportional", judged["reason"],
            condition="the session must run with TimeZone=UTC, or the table is rewritten"))
        .when(judged["outcome"] == "rewrite", _result("proportional", judged["reason"]))
        .otherwise(_result("unresolved", judged["reason"]))
    )


def _constraint_gap(facts: Column) -> Column:
    """Why the constraints cannot be read, NULL when they can."""
    return (
        F.when(facts.isNull(), F.lit("relation not captured in the snapshot"))
        .when(~has(facts["exists"]), F.lit("existence unknown"))
        .when(facts["exists"]["value"] == F.lit(False), F.lit("relation does not exist"))
        .when(~has_value(facts["constraints"]), F.coalesce(
            facts["constraints"]["reason"], F.lit("constraints not gathered")))
    )


def set_not_null(action: Column, facts: Column) -> Column:
    column = action["column"]
    already = F.coalesce(has(facts["columns"]) & F.exists(
        facts["columns"]["value"], lambda c: (c["name"] == column) & c["not_null"]),
        F.lit(False))
    proved = F.exists(facts["constraints"]["value"], lambda c: c["validated"] & (
        ((c["contype"] == "c") & F.coalesce(proves_not_null(c["check_expression"], column),
                                            F.lit(False)))
        | ((c["contype"] == "n") & F.array_contains(c["columns"], column))))
    gap = _constraint_gap(facts)
    return (
        F.when(column.isNull(), _result("unresolved", "no column name is recorded"))
        .when(already, _result("constant", "nothing to do: the column holds no NULL by definition"))
        .when(gap.isNotNull(), _result("unresolved", F.concat(
            F.lit("constraints could not be read: "), gap)))
        .when(F.coalesce(proved, F.lit(False)),
              _result("constant", "a valid constraint proves NOT NULL, so the scan is skipped"))
        .otherwise(_result("proportional", "nothing proves NOT NULL: the table is scanned"))
    )


def _named(action: Column, facts: Column) -> Column:
    return F.try_element_at(F.filter(
        facts["constraints"]["value"], lambda c: c["name"] == action["constraint_name"]),
        F.lit(1))


def validate_constraint(action: Column, facts: Column) -> Column:
    return let(_named(action, facts), lambda named: _validated(_constraint_gap(facts), named))


def _validated(gap: Column, named: Column) -> Column:
    return (
        F.when(gap.isNotNull(), _result("unresolved", F.concat(
            F.lit("constraints could not be read: "), gap)))
        .when(named.isNull(), _result("unresolved", "the constraint is not on the relation"))
        .when(named["validated"], _result("constant", "the constraint is already valid"))
        .when(named["contype"] == "f", _result(
            "proportional", "a foreign key is validated against the referenced table",
            extra_relation=named["referenced_table"], extra_level=_ROW_SHARE,
            family="fk_validation"))
        .otherwise(_result("proportional", "the table is scanned"))
    )


def drop_constraint(action: Column, facts: Column) -> Column:
    return let(_named(action, facts), lambda named: _dropped(
        _constraint_gap(facts), named, F.coalesce(action["missing_ok"], F.lit(False))))


def _dropped(gap: Column, named: Column, missing_ok: Column) -> Column:
    return (
        F.when(gap.isNotNull(), _result("unresolved", F.concat(
            F.lit("constraints could not be read: "), gap)))
        .when(named.isNull(), F.when(
            missing_ok,
            _result("constant", "the constraint is absent: IF EXISTS does nothing"))
            .otherwise(_result("constant", "the constraint is absent: the statement fails")))
        .when(named["contype"] == "f", _result(
            "constant", "dropping a foreign key also locks the referenced table",
            extra_relation=named["referenced_table"], extra_level=_ACCESS_EXCLUSIVE))
        .otherwise(_result("constant", "only this table is locked"))
    )


def add_pk_using_index(facts: Column) -> Column:
    all_set = F.coalesce(has_value(facts["columns"]) & F.forall(
        facts["columns"]["value"], lambda c: c["not_null"]), F.lit(False))
    return F.when(all_set, _result("constant", "nothing to do: no column can hold a NULL")).otherwise(
        _result("keep_model", "a nullable index column would cause a scan",
                method=F.when(facts.isNull(), "unverified").otherwise("observed")))


def set_expression(action: Column, facts: Column) -> Column:
    generated = F.try_element_at(F.transform(F.filter(
        F.when(has(facts["columns"]), facts["columns"]["value"]),
        lambda c: (c["name"] == action["column"]) & c["generated"].isin("v", "s")),
        lambda c: c["generated"]), F.lit(1))
    return (
        F.when(generated == "v", _result("constant", "a virtual column stores nothing"))
        .when(generated == "s", _result("proportional", "a stored column is recomputed"))
        .otherwise(_result("unresolved", "stored or virtual could not be read"))
    )


def narrow_action(kind: Column, action: Column, facts: Column, type_facts: Column,
                  change: Column, live: Column, pg_version: Column, target: Column) -> Column:
    """The narrowing of the action's kind; NULL when none is defined."""
    return (
        F.when(kind == "add_column_default_nonvolatile", add_column_domain(action, type_facts))
        .when(kind == "add_column_default_unknown_volatility",
              add_column_unknown_volatility(action, type_facts, live))
        .when(kind == "alter_column_type",
              alter_column_type(action, facts, change, pg_version, target))
        .when(kind.isin("set_not_null", "add_not_null_constraint"), set_not_null(action, facts))
        .when(kind == "validate_constraint", validate_constraint(action, facts))
        .when(kind == "drop_constraint", drop_constraint(action, facts))
        .when(kind == "add_primary_key_using_index", add_pk_using_index(facts))
        .when(kind == "set_expression", set_expression(action, facts))
    )
