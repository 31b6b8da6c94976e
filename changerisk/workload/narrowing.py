"""Narrowing by catalog facts; the facts come from parts, customers and suppliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.functions.facts import fact, known, unavailable
from changerisk.functions.types import assess_type_change
from changerisk.operators import narrow
from changerisk.schemas import ACTION, RELATION_FACTS
from changerisk.workload.adapters import pick, table
from changerisk.workload.registry import query

FIELDS = [part.split(":")[0] for part in
          ("kind:column:column_type:constraint_name:not_null:not_valid:has_using:using_index:"
           "missing_ok:referenced_table:partition:default_volatility:default_expression:"
           "unknown_functions").split(":")]


def action(**given: Column) -> Column:
    """An action struct with the given fields; the others are NULL."""
    return F.struct(*[given.get(f, F.lit(None)).alias(f) for f in FIELDS]).cast(ACTION)


def nulls(type_: str) -> Column:
    return F.lit(None).cast(type_)


def relation_facts(**given: Column) -> Column:
    """Relation facts of an existing relation; what is not given was not gathered."""
    types = {"exists": "boolean", "reltuples": "bigint", "n_mod": "bigint",
             "last_analyze": "timestamp", "last_autoanalyze": "timestamp",
             "size_bytes": "bigint", "indexes": None, "columns": None, "constraints": None}
    empty = F.lit(None).cast(RELATION_FACTS)
    return F.struct(*[given[n].alias(n) if n in given else empty[n].alias(n) for n in types])


def parts(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", "p_size")


def outcome(struct: Column) -> list[Column]:
    return [struct["outcome"].alias("outcome"), struct["method"].alias("method")]


@query("narrow_default_domain", """
SELECT p_partkey, CASE WHEN f = 0 OR f = 1 OR (f IN (3, 4) AND p_size % 5 = 0) THEN 'unresolved'
  WHEN f = 2 THEN 'constant' WHEN p_size % 3 = 0 OR (f = 4 AND p_size % 2 = 0)
  THEN 'proportional' ELSE 'constant' END AS outcome,
  CASE WHEN f = 0 OR f = 1 OR (f IN (3, 4) AND p_size % 5 = 0) THEN 'unverified' ELSE 'observed'
  END AS method
FROM (SELECT p_partkey, p_size, p_partkey % 5 AS f FROM part)""")
def narrow_default_domain(spark, sf):
    key, size = F.col("p_partkey") % 5, F.col("p_size")
    why = F.lit("not gathered")
    type_facts = F.when(key != 0, F.struct(
        known(F.lit(True)).alias("exists"),
        fact(key != 1, key > 2, why, "boolean").alias("is_domain"),
        known((key == 4) & (size % 2 == 0)).alias("domain_not_null"),
        fact(size % 5 != 0, F.when(size % 3 == 0, 2).otherwise(0), why, "bigint"
             ).alias("domain_constraint_count")))
    return parts(spark, sf).withColumn("t", type_facts).select("p_partkey", *outcome(
        narrow.add_column_domain(action(column_type=F.lit("d")), F.col("t"))))


@query("narrow_default_volatility", """
SELECT p_partkey, CASE WHEN f = 0 THEN 'unresolved' WHEN f = 1 THEN 'proportional'
  WHEN f = 2 THEN 'constant' ELSE 'unresolved' END AS outcome,
  CASE WHEN f IN (1, 2) THEN 'observed' ELSE 'unverified' END AS method
FROM (SELECT p_partkey, p_partkey % 4 AS f FROM part)""")
def narrow_default_volatility(spark, sf):
    key = F.col("p_partkey") % 4
    # no fact, a volatile function, an immutable one, an immutable one without type facts
    live = F.when(key == 1, F.create_map(F.lit("my_fn"), F.lit(4))).when(
        key > 1, F.create_map(F.lit("my_fn"), F.lit(1)))
    type_facts = F.when(key != 3, F.struct(
        known(F.lit(True)).alias("exists"), known(F.lit(False)).alias("is_domain"),
        known(F.lit(False)).alias("domain_not_null"),
        known(F.lit(0).cast("bigint")).alias("domain_constraint_count")))
    act = action(column_type=F.lit("text"), default_volatility=F.lit("unknown"),
                 default_expression=F.lit("my_fn('x')"))
    return parts(spark, sf).withColumns({"t": type_facts, "live": live}).select(
        "p_partkey", *outcome(narrow.add_column_unknown_volatility(act, F.col("t"),
                                                                   F.col("live"))))


# current type, new type, same base, cast method, target is a domain, outcome without USING
CHANGES = [
    ("character varying(10)", "varchar(20)", True, None, False, "no_rewrite"),
    ("character varying(20)", "varchar(10)", True, None, False, "rewrite"),
    ("character varying(20)", "text", False, "b", False, "no_rewrite"),
    ("text", "varchar(20)", False, "b", False, "rewrite"),
    ("integer", "bigint", False, "f", False, "rewrite"),
    ("integer", "jsonb", False, None, False, "rewrite"),
    ("numeric(10,2)", "numeric(12,2)", True, None, False, "no_rewrite"),
    ("numeric(10,2)", "numeric(12,3)", True, None, False, "rewrite"),
    ("timestamp without time zone", "timestamptz", False, "f", False, "utc"),
    ("timestamp(6) without time zone", "timestamptz(3)", False, "f", False, "rewrite"),
    ("text", "dom", True, None, True, "no_rewrite"),
    ("text", "text[]", False, None, False, "unknown"),
    ("character varying(10)", "varchar(10)", True, None, False, "no_rewrite"),
    ("character(10)", "char(20)", True, None, False, "rewrite"),
]


def change_facts(position: Column, available: Column) -> Column:
    why = F.lit("type does not exist")

    def entry(i: int, type_: str) -> Column:
        return pick_any([c[i] for c in CHANGES], position).cast(type_)

    none = F.lit(0).cast("bigint")
    return F.struct(
        known(entry(0, "string")).alias("current_type"),
        known(F.lit(False)).alias("current_is_domain"),
        fact(available, entry(1, "string"), why, "string").alias("new_type"),
        fact(available, entry(4, "boolean"), why, "boolean").alias("new_is_domain"),
        fact(available, F.lit(False), why, "boolean").alias("new_domain_not_null"),
        fact(available, none, why, "bigint").alias("new_domain_constraint_count"),
        fact(available, F.lit(False), why, "boolean").alias("new_domain_has_typmod"),
        fact(available, F.lit(False), why, "boolean").alias("same_type"),
        fact(available, entry(2, "boolean"), why, "boolean").alias("bases_same"),
        fact(available, entry(3, "string"), why, "string").alias("cast_method"))


def pick_any(values: list, position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (position + 1).cast("int"))


def _listed(values: list[str], position: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[{position} + 1]"


_CHANGE = f"p_partkey % {len(CHANGES)}"
_EXPECTED = _listed([c[5] for c in CHANGES], _CHANGE)


@query("type_change_assessment", f"""
SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'rewrite' WHEN p_size % 9 = 0 THEN 'unknown'
  WHEN {_EXPECTED} = 'utc' THEN CASE WHEN p_size % 2 = 0 THEN 'no_rewrite_if_utc' ELSE 'rewrite' END
  ELSE {_EXPECTED} END AS outcome FROM part""")
def type_change_assessment(spark, sf):
    size, position = F.col("p_size"), F.col("p_partkey") % len(CHANGES)
    change = change_facts(position, size % 9 != 0)
    judged = assess_type_change(
        F.col("change"), pick([c[1] for c in CHANGES], position), size % 10 == 0,
        F.when(size % 2 == 0, 17).otherwise(11))
    return parts(spark, sf).withColumn("change", change).select(
        "p_partkey", judged["outcome"].alias("outcome"))


@query("narrow_type_change", f"""
WITH p AS (SELECT p_partkey, p_size, {_EXPECTED} AS e FROM part)
SELECT p_partkey, CASE WHEN p_size % 9 = 0 OR e = 'unknown' THEN 'unresolved'
  WHEN e = 'no_rewrite' AND p_size % 4 = 0 THEN 'unresolved'
  WHEN e = 'no_rewrite' AND p_size % 4 = 1 THEN 'constant' ELSE 'proportional' END AS outcome,
  CASE WHEN p_size % 9 <> 0 AND e = 'no_rewrite' AND p_size % 4 = 2 THEN 'index_build_btree'
       WHEN p_size % 9 <> 0 AND e = 'no_rewrite' AND p_size % 4 = 3
       THEN 'index_build_btree,index_build_expression' ELSE '' END AS rebuilds,
  p_size % 9 <> 0 AND e = 'no_rewrite' AND p_size % 4 > 0 AS relabel,
  p_size % 9 <> 0 AND e = 'utc' AS conditional FROM p""")
def narrow_type_change(spark, sf):
    size, position = F.col("p_size"), F.col("p_partkey") % len(CHANGES)

    def index(partial: bool, method: str, column: str) -> Column:
        return F.struct(
            F.lit("ix").alias("name"), F.lit(True).alias("valid"),
            known(F.lit(1).cast("bigint")).alias("size_bytes"), F.lit(method).alias("method"),
            F.lit(partial).alias("partial"), F.lit(False).alias("has_expressions"),
            F.lit(True).alias("default_opclasses"), F.array(F.lit(column)).alias("depends_on"))

    plain, partial = index(False, "btree", "c"), index(True, "btree", "c")
    gin, other = index(False, "gin", "c"), index(True, "gin", "d")
    indexes = F.when(size % 4 == 1, F.array(plain, other)).when(
        size % 4 == 2, F.array(plain, partial)).otherwise(F.array(partial, other, gin))
    facts = F.when(size % 4 != 0, relation_facts(exists=known(F.lit(True)),
                                                 indexes=known(indexes)))
    act = action(column=F.lit("c"), column_type=pick([c[1] for c in CHANGES], position),
                 has_using=F.lit(False))
    rows = parts(spark, sf).withColumns({
        "change": change_facts(position, size % 9 != 0), "facts": facts, "a": act})
    rows = rows.withColumn("n", narrow.alter_column_type(
        F.col("a"), F.col("facts"), F.col("change"), F.lit(17), F.lit("t")))
    return rows.select("p_partkey", F.col("n.outcome").alias("outcome"),
                       F.array_join("n.rebuilds", ",").alias("rebuilds"),
                       F.col("n.relabel").alias("relabel"),
                       F.col("n.condition").isNotNull().alias("conditional"))


def constrained(spark, sf) -> DataFrame:
    """One relation per customer with one constraint; some facts are missing."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    check = F.when(key % 3 == 0, F.lit("((c1 IS NOT NULL) AND (c1 > 0))")).when(
        key % 3 == 1, F.lit("((c1 > 0))"))
    constraint = F.struct(
        F.lit("k").alias("name"),
        F.when(key % 3 != 2, "c").when(nation % 2 == 0, "f").otherwise("n").alias("contype"),
        (nation % 4 != 0).alias("validated"), F.array(F.lit("c1")).alias("columns"),
        check.alias("check_expression"),
        F.when((key % 3 == 2) & (nation % 2 == 0), F.lit("app.parent")).alias(
            "referenced_table"))
    columns = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: F.struct(
        F.concat(F.lit("c"), j.cast("string")).alias("name"), (j + 1).alias("attnum"),
        F.lit("int").alias("data_type"), ((key + j) % 7 == 0).alias("not_null"),
        F.lit(False).alias("has_default"), F.lit("").alias("identity"),
        F.when((key + j) % 5 == 0, "v").when((key + j) % 5 == 1, "s").otherwise("")
        .alias("generated"), F.lit(False).alias("is_domain")))
    column_type = "array<struct<name:string,attnum:int,data_type:string,not_null:boolean," \
                  "has_default:boolean,identity:string,generated:string,is_domain:boolean>>"
    facts = F.when(nation != 24, relation_facts(
        exists=known(nation != 23),
        columns=F.when(nation == 22, unavailable(F.lit("timeout"), column_type)).otherwise(
            known(columns.cast(column_type))),
        constraints=F.when(nation == 21, unavailable(
            F.lit("timeout"), "array<struct<name:string,contype:string,validated:boolean,"
            "columns:array<string>,check_expression:string,referenced_table:string>>")).otherwise(
            known(F.array(constraint)))))
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", facts.alias("facts"))


_GAP = "c_nationkey IN (24, 23, 21)"
_CONTYPE = ("CASE WHEN c_custkey % 3 <> 2 THEN 'c' WHEN c_nationkey % 2 = 0 THEN 'f' ELSE 'n' END")


@query("narrow_set_not_null", f"""
SELECT c_custkey, CASE
  WHEN c_nationkey NOT IN (24, 22) AND (c_custkey + 1) % 7 = 0 THEN 'constant'
  WHEN {_GAP} THEN 'unresolved'
  WHEN c_nationkey % 4 <> 0 AND (c_custkey % 3 = 0 OR {_CONTYPE} = 'n') THEN 'constant'
  ELSE 'proportional' END AS outcome FROM customer""")
def narrow_set_not_null(spark, sf):
    rows = constrained(spark, sf).withColumn("n", narrow.set_not_null(
        action(column=F.lit("c1")), F.col("facts")))
    return rows.select("c_custkey", F.col("n.outcome").alias("outcome"))


@query("narrow_validate_constraint", f"""
SELECT c_custkey, CASE WHEN {_GAP} OR c_custkey % 11 = 0 THEN 'unresolved'
  WHEN c_nationkey % 4 <> 0 THEN 'constant' ELSE 'proportional' END AS outcome,
  CASE WHEN NOT ({_GAP}) AND c_custkey % 11 <> 0 AND c_nationkey % 4 = 0 AND {_CONTYPE} = 'f'
       THEN 'app.parent/2/fk_validation' ELSE '' END AS extra FROM customer""")
def narrow_validate_constraint(spark, sf):
    name = F.when(F.col("c_custkey") % 11 == 0, "other").otherwise("k")
    rows = constrained(spark, sf).withColumn("n", narrow.validate_constraint(
        action(constraint_name=name), F.col("facts")))
    return rows.select("c_custkey", F.col("n.outcome").alias("outcome"), F.concat_ws(
        "/", "n.extra_relation", "n.extra_level", "n.family").alias("extra"))


@query("narrow_drop_constraint", f"""
SELECT c_custkey, CASE WHEN {_GAP} THEN 'unresolved' ELSE 'constant' END AS outcome,
  CASE WHEN {_GAP} THEN 'gap' WHEN c_custkey % 11 = 0 THEN CASE WHEN c_custkey % 2 = 0
       THEN 'nothing to do' ELSE 'fails' END
       WHEN {_CONTYPE} = 'f' THEN 'app.parent/8' ELSE 'this table' END AS detail FROM customer""")
def narrow_drop_constraint(spark, sf):
    name = F.when(F.col("c_custkey") % 11 == 0, "other").otherwise("k")
    rows = constrained(spark, sf).withColumn("n", narrow.drop_constraint(action(
        constraint_name=name, missing_ok=F.col("c_custkey") % 2 == 0), F.col("facts")))
    n = F.col("n")
    detail = (F.when(n["outcome"] == "unresolved", "gap")
              .when(F.contains(n["reason"], F.lit("IF EXISTS")), "nothing to do")
              .when(F.contains(n["reason"], F.lit("fails")), "fails")
              .when(n["extra_level"].isNotNull(), F.concat_ws(
                  "/", n["extra_relation"], n["extra_level"])).otherwise("this table"))
    return rows.select("c_custkey", n["outcome"].alias("outcome"), detail.alias("detail"))


@query("narrow_primary_key_using_index", """
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 1 THEN 'constant' ELSE 'keep_model' END AS outcome,
  CASE WHEN s_suppkey % 4 = 0 THEN 'unverified' ELSE 'observed' END AS method FROM supplier""")
def narrow_primary_key_using_index(spark, sf):
    key = F.col("s_suppkey") % 4

    def columns(flags: list[bool]) -> Column:
        return F.array(*[F.struct(
            F.lit(f"c{i}").alias("name"), F.lit(i).alias("attnum"), F.lit("int").alias(
                "data_type"), F.lit(flag).alias("not_null"), F.lit(False).alias("has_default"),
            F.lit("").alias("identity"), F.lit("").alias("generated"),
            F.lit(False).alias("is_domain")) for i, flag in enumerate(flags)])

    facts = F.when(key != 0, relation_facts(exists=known(F.lit(True)), columns=known(
        F.when(key == 1, columns([True, True])).otherwise(columns([True, False])))))
    return table(spark, sf, "supplier").withColumn("facts", facts).select(
        "s_suppkey", *outcome(narrow.add_pk_using_index(F.col("facts"))))


@query("narrow_set_expression", """
SELECT c_custkey, CASE WHEN c_nationkey IN (24, 22) THEN 'unresolved'
  WHEN (c_custkey + 1) % 5 = 0 THEN 'constant' WHEN (c_custkey + 1) % 5 = 1 THEN 'proportional'
  ELSE 'unresolved' END AS outcome FROM customer""")
def narrow_set_expression(spark, sf):
    rows = constrained(spark, sf).withColumn("n", narrow.set_expression(
        action(column=F.lit("c1")), F.col("facts")))
    return rows.select("c_custkey", F.col("n.outcome").alias("outcome"))


KINDS = ["set_not_null", "validate_constraint", "drop_constraint", "set_expression",
         "add_foreign_key", "add_primary_key_using_index", "alter_column_type"]


@query("narrow_dispatch", f"""
WITH c AS (SELECT *, {_listed(KINDS, f'c_custkey % {len(KINDS)}')} AS kind FROM customer)
SELECT kind, CASE kind WHEN 'add_foreign_key' THEN 'none'
  WHEN 'alter_column_type' THEN 'unresolved'
  WHEN 'add_primary_key_using_index' THEN 'keep_model'
  WHEN 'drop_constraint' THEN CASE WHEN {_GAP} THEN 'unresolved' ELSE 'constant' END
  WHEN 'validate_constraint' THEN CASE WHEN {_GAP} THEN 'unresolved'
       WHEN c_nationkey % 4 <> 0 THEN 'constant' ELSE 'proportional' END
  WHEN 'set_expression' THEN CASE WHEN c_nationkey IN (24, 22) THEN 'unresolved'
       WHEN (c_custkey + 1) % 5 = 0 THEN 'constant'
       WHEN (c_custkey + 1) % 5 = 1 THEN 'proportional' ELSE 'unresolved' END
  ELSE CASE WHEN c_nationkey NOT IN (24, 22) AND (c_custkey + 1) % 7 = 0 THEN 'constant'
       WHEN {_GAP} THEN 'unresolved'
       WHEN c_nationkey % 4 <> 0 AND (c_custkey % 3 = 0 OR {_CONTYPE} = 'n') THEN 'constant'
       ELSE 'proportional' END END AS outcome, count(*) AS n
FROM c GROUP BY 1, 2""")
def narrow_dispatch(spark, sf):
    kind = pick(KINDS, F.col("c_custkey") % len(KINDS))
    rows = constrained(spark, sf).withColumns({
        "kind": kind, "a": action(column=F.lit("c1"), constraint_name=F.lit("k"))})
    rows = rows.withColumn("n", narrow.narrow_action(
        F.col("kind"), F.col("a"), F.col("facts"), nulls(
            "struct<is_domain:struct<available:boolean,value:boolean,reason:string>,"
            "domain_not_null:struct<available:boolean,value:boolean,reason:string>,"
            "domain_constraint_count:struct<available:boolean,value:bigint,reason:string>>"),
        change_facts(F.lit(0), F.lit(True)), nulls("map<string,int>"), F.lit(17), F.lit("t")))
    return rows.select("kind", F.coalesce("n.outcome", F.lit("none")).alias("outcome")).groupBy(
        "kind", "outcome").agg(F.count("*").alias("n"))
