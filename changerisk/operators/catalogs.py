"""Snapshot facts from exported system catalogs of many databases.

Inputs keep the server's column names plus ``db_id``; every join has ``db_id``
in its key. Functions return one row per fact; ``nest_relation_facts`` builds
the nested form the assessment reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changerisk.functions.durations import int_div
from changerisk.functions.facts import fact, known
from changerisk.functions.names import own_part, schema_part
from changerisk.operators.recursion import descend, fold_chains, fold_subtrees
from changerisk.seeds import tables
from changerisk.session import broadcast_if_small

MASKED = "statistics are masked for the introspection role"
ADD_COLUMN_KINDS = [r["kind"] for r in tables.rule_rows() if r["kind"].startswith("add_column")]


# --- what to ask -----------------------------------------------------------------
def probes(units: DataFrame) -> DataFrame:
    """Distinct things a corpus asks a database about.

    ``units`` are statement parts before resolution. One row per (db_id, probe,
    relation, name, type); unused columns are NULL.
    """
    none = F.lit(None).cast("string")
    first = F.try_element_at("targets", F.lit(1))
    a = F.col("action")

    def probe(what: str, relation: Column, name: Column, type_: Column) -> Column:
        return F.struct(F.lit(what).alias("probe"), relation.alias("relation"),
                        name.alias("name"), type_.alias("type"))

    names = F.filter(F.concat(
        F.coalesce("targets", F.array().cast("array<string>")),
        F.coalesce("referenced_tables", F.array().cast("array<string>")),
        F.array(F.col("partition_of"), a["referenced_table"], a["partition"])),
        lambda n: n.isNotNull())
    change = (F.col("kind") == "alter_column_type") & first.isNotNull() & a[
        "column"].isNotNull() & a["column_type"].isNotNull()
    asked = F.concat(
        F.transform(names, lambda n: probe("relation", n, none, none)),
        F.transform(F.coalesce(a["unknown_functions"], F.array().cast("array<string>")),
                    lambda f: probe("function", none, f, none)),
        F.array_compact(F.array(
            F.when(F.col("kind").isin(*ADD_COLUMN_KINDS) & a["column_type"].isNotNull(),
                   probe("type", none, none, a["column_type"])),
            F.when(change, probe("type_change", first, a["column"], a["column_type"])))))
    return units.select("db_id", F.explode(asked).alias("p")).select("db_id", "p.*").distinct()


# --- relations ---------------------------------------------------------------------
def search_ranks(spaces: DataFrame, search_path: tuple[str, ...] | DataFrame) -> DataFrame:
    """``spaces(db_id, nspname)`` with ``place``, the schema's rank in the search path or NULL.

    The path is one list for every database, or rows ``(db_id, nspname, place)``.
    """
    if isinstance(search_path, DataFrame):
        ranked = search_path.groupBy("db_id", "nspname").agg(F.min("place").alias("place"))
        return spaces.join(broadcast_if_small(ranked), ["db_id", "nspname"], "left")
    place = F.array_position(F.array(*[F.lit(n) for n in search_path]), F.col("nspname"))
    return spaces.withColumn("place", F.nullif(place, F.lit(0)))


def resolve_relations(requested: DataFrame, pg_class: DataFrame, pg_namespace: DataFrame,
                      search_path: tuple[str, ...] | DataFrame = ("public",)) -> DataFrame:
    """Requested names with their catalog row; an absent one stays with exists=false.

    ``requested(db_id, requested)`` are spelled names: quoted parts are taken as
    they stand, others in lower case. An unqualified name is the relation of
    that name in the first schema of ``search_path`` that has one. A row
    estimate of -1 is unavailable, not a number.
    """
    asked = requested.select("db_id", "requested",
                             F.coalesce(schema_part(F.col("requested")), F.lit("")).alias("asked_in"),
                             own_part(F.col("requested")).alias("relname"))
    spaces = search_ranks(pg_namespace.select("db_id", F.col("oid").alias("relnamespace"), "nspname"),
                          search_path)
    named = pg_class.join(broadcast_if_small(spaces), ["db_id", "relnamespace"])
    row = F.struct(*[F.col(c) for c in named.columns if c not in ("db_id", "relname")])
    # One row per name that is visible without its schema, folded before the shuffle.
    visible = named.where("place IS NOT NULL").groupBy("db_id", "relname").agg(
        F.min_by(row, F.struct("place", "oid")).alias("row")).withColumn("asked_in", F.lit(""))
    known_as = named.select("db_id", "relname", row.alias("row"), F.col("nspname").alias("asked_in")
                            ).unionByName(visible)
    found = asked.join(known_as, ["db_id", "asked_in", "relname"], "left").select(
        "db_id", "requested", "relname", "row.*")
    exists = F.col("oid").isNotNull()
    absent = F.lit("relation does not exist")
    return found.select(
        "db_id", "requested", "oid", "nspname", "relname", "relkind", exists.alias("exists"),
        fact(exists, F.col("relpages"), absent, "bigint").alias("relpages"),
        fact(exists & (F.col("reltuples") >= 0), F.col("reltuples"),
             F.when(exists, F.lit("reltuples is -1: never been vacuumed or analyzed"))
             .otherwise(absent), "bigint").alias("reltuples"))


def statistics_facts(resolved: DataFrame, pg_stat: DataFrame) -> DataFrame:
    """Analyze times and churn; without a statistics row they are unavailable."""
    stats = pg_stat.select("db_id", F.col("relid").alias("oid"), "last_analyze",
                           "last_autoanalyze", "n_mod_since_analyze",
                           F.lit(True).alias("__hit"))
    joined = resolved.join(stats, ["db_id", "oid"], "left")
    hit, why = F.coalesce("__hit", F.lit(False)), F.lit("no statistics row for the relation")
    return joined.select(
        *resolved.columns,
        fact(hit, F.col("last_analyze"), why, "timestamp").alias("last_analyze"),
        fact(hit, F.col("last_autoanalyze"), why, "timestamp").alias("last_autoanalyze"),
        fact(hit, F.col("n_mod_since_analyze"), why, "bigint").alias("n_mod"))


def partition_totals(roots: DataFrame, pg_inherits: DataFrame, sizes: DataFrame) -> DataFrame:
    """Number and total size of everything below each partitioned relation.

    Partitions have one parent: their totals are gathered upwards, in as many
    rounds as the depth has bits. Only where some table inherits from several
    are the nodes below each root walked and counted once.
    """
    links = pg_inherits.select("db_id", F.col("inhparent").alias("node"),
                               F.col("inhrelid").alias("next")).distinct()
    sized = sizes.select("db_id", F.col("oid").alias("node"), "total_bytes")
    start = roots.select("db_id", F.col("oid").alias("root"))
    several = links.groupBy("db_id", "next").agg(F.count("*").alias("n")).where("n > 1")
    if several.isEmpty():
        names = links.select("db_id", "node").unionByName(
            links.select("db_id", F.col("next").alias("node"))).distinct()
        nodes = (names.join(links.select("db_id", F.col("node").alias("parent"),
                                         F.col("next").alias("node")), ["db_id", "node"], "left")
                 .join(sized, ["db_id", "node"], "left").withColumn("one", F.lit(1)))
        own = sized.select("db_id", F.col("node").alias("root"), F.col("total_bytes").alias("own"))
        totals = (fold_subtrees(nodes, ["db_id"], ["one", "total_bytes"])
                  .withColumnRenamed("node", "root").join(own, ["db_id", "root"], "left")
                  .select("db_id", "root", (F.col("one") - 1).alias("partitions"),
                          (F.col("total_bytes") - F.coalesce("own", F.lit(0))).alias("total_bytes")))
    else:
        below = descend(start.withColumn("node", F.col("root")), links, ["db_id"], ["root"]).filter(
            "depth > 0")
        totals = below.join(sized, ["db_id", "node"], "left").groupBy("db_id", "root").agg(
            F.count("*").alias("partitions"), F.sum("total_bytes").alias("total_bytes"))
    return start.join(totals, ["db_id", "root"], "left").select(
        "db_id", "root", F.coalesce("partitions", F.lit(0)).alias("partitions"),
        F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"))


def index_facts(pg_index: DataFrame, pg_class: DataFrame, pg_am: DataFrame,
                pg_opclass: DataFrame, pg_depend: DataFrame,
                pg_attribute: DataFrame) -> DataFrame:
    """Indexes with their method, shape and the columns they depend on.

    The columns are the key columns together with the ones an expression or
    predicate refers to; an index has few, so they are collected and sorted.
    """
    classes = pg_class.select("db_id", F.col("oid").alias("indexrelid"),
                              F.col("relname").alias("name"), F.col("relam").alias("amoid"))
    methods = pg_am.select("db_id", F.col("oid").alias("amoid"), F.col("amname").alias("method"))
    base = (pg_index.join(classes, ["db_id", "indexrelid"])
            .join(broadcast_if_small(methods), ["db_id", "amoid"]))
    key_columns = base.select("db_id", "indexrelid", "indrelid",
                              F.explode("indkey").alias("attnum")).filter("attnum > 0")
    referred = base.select("db_id", "indexrelid", "indrelid").join(
        pg_depend.select("db_id", F.col("objid").alias("indexrelid"),
                         F.col("refobjid").alias("indrelid"),
                         F.col("refobjsubid").alias("attnum")).filter("attnum > 0"),
        ["db_id", "indexrelid", "indrelid"])
    attributes = pg_attribute.select("db_id", F.col("attrelid").alias("indrelid"), "attnum",
                                     "attname")
    depends = (key_columns.unionByName(referred.select(*key_columns.columns))
               .join(attributes, ["db_id", "indrelid", "attnum"])
               .groupBy("db_id", "indexrelid")
               .agg(F.array_sort(F.collect_set("attname")).alias("depends_on")))
    classes_used = base.select("db_id", "indexrelid", F.explode("indclass").alias("opc"))
    defaults = (classes_used.join(broadcast_if_small(pg_opclass.select(
        "db_id", F.col("oid").alias("opc"), "opcdefault")), ["db_id", "opc"])
        .groupBy("db_id", "indexrelid").agg(F.bool_and("opcdefault").alias("defaults")))
    return (base.join(depends, ["db_id", "indexrelid"], "left")
            .join(defaults, ["db_id", "indexrelid"], "left")
            .select("db_id", "indrelid", "indexrelid", "name", "method",
                    F.col("indisvalid").alias("valid"),
                    F.col("indpred").isNotNull().alias("partial"),
                    F.col("indexprs").isNotNull().alias("has_expressions"),
                    F.coalesce("defaults", F.lit(True)).alias("default_opclasses"),
                    F.coalesce("depends_on", F.array().cast("array<string>")
                               ).alias("depends_on")))


def index_sizes(indexes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per relation: index count, invalid indexes, bytes; unsized indexes are counted apart."""
    sized = indexes.join(sizes.select("db_id", F.col("oid").alias("indexrelid"),
                                      F.col("rel_bytes")), ["db_id", "indexrelid"], "left")
    return sized.groupBy("db_id", "indrelid").agg(
        F.count("*").alias("indexes"),
        F.array_sort(F.collect_list(F.when(~F.col("valid"), F.col("name")))).alias("invalid"),
        F.coalesce(F.sum("rel_bytes"), F.lit(0)).alias("index_bytes"),
        F.count_if(F.col("rel_bytes").isNull()).alias("unsized"))


def column_facts(pg_attribute: DataFrame, pg_type: DataFrame, pg_attrdef: DataFrame,
                 pg_constraint: DataFrame) -> DataFrame:
    """Live columns with type, default and domain facts.

    The domain's checks are counted once per type and joined.
    """
    checks = (pg_constraint.filter((F.col("contype") == "c") & F.col("contypid").isNotNull())
              .groupBy("db_id", F.col("contypid").alias("atttypid"))
              .agg(F.count("*").alias("checks")))
    types = pg_type.select("db_id", F.col("oid").alias("atttypid"), "typname", "typtype",
                           "typnotnull")
    types = types.join(checks, ["db_id", "atttypid"], "left")
    defaults = pg_attrdef.select("db_id", F.col("adrelid").alias("attrelid"),
                                 F.col("adnum").alias("attnum"), F.col("adbin"))
    is_domain = F.col("typtype") == "d"
    return (pg_attribute.filter((F.col("attnum") > 0) & ~F.col("attisdropped"))
            .join(types, ["db_id", "atttypid"])
            .join(defaults, ["db_id", "attrelid", "attnum"], "left")
            .select("db_id", "attrelid", "attnum", "attname", F.col("typname").alias("data_type"),
                    F.col("attnotnull").alias("not_null"),
                    F.col("adbin").alias("default_expression"), "attidentity", "attgenerated",
                    is_domain.alias("is_domain"),
                    (is_domain & F.col("typnotnull")).alias("domain_not_null"),
                    F.when(is_domain, F.coalesce("checks", F.lit(0))).otherwise(0)
                    .alias("domain_checks")))


def dropped_columns(pg_attribute: DataFrame) -> DataFrame:
    return pg_attribute.groupBy("db_id", "attrelid").agg(
        F.count_if("attisdropped").alias("dropped"))


def constraint_facts(pg_constraint: DataFrame, pg_attribute: DataFrame, pg_class: DataFrame,
                     pg_namespace: DataFrame) -> DataFrame:
    """Constraints with ordered column names and the referenced table.

    A key lists a bounded number of columns, so they are collected in order.
    """
    on_relation = pg_constraint.filter(F.col("conrelid").isNotNull())
    keys = on_relation.select("db_id", F.col("oid").alias("con"),
                              F.col("conrelid").alias("attrelid"),
                              F.posexplode("conkey").alias("place", "attnum"))
    columns = (keys.join(pg_attribute.select("db_id", "attrelid", "attnum", "attname"),
                         ["db_id", "attrelid", "attnum"])
               .groupBy("db_id", F.col("con").alias("oid"))
               .agg(F.array_sort(F.collect_list(F.struct("place", "attname"))).alias("k"))
               .select("db_id", "oid", F.col("k.attname").alias("columns")))
    names = pg_class.join(broadcast_if_small(pg_namespace.select(
        "db_id", F.col("oid").alias("relnamespace"), "nspname")), ["db_id", "relnamespace"]
        ).select("db_id", F.col("oid").alias("confrelid"),
                 F.concat_ws(".", "nspname", "relname").alias("referenced_table"))
    return (on_relation.join(columns, ["db_id", "oid"], "left")
            .join(names, ["db_id", "confrelid"], "left")
            .select("db_id", "conrelid", "oid", F.col("conname").alias("name"), "contype",
                    F.col("convalidated").alias("validated"),
                    F.coalesce("columns", F.array().cast("array<string>")).alias("columns"),
                    F.when(F.col("contype") == "c", F.col("conbin")).alias("check_expression"),
                    "referenced_table"))


def nest_relation_facts(resolved: DataFrame, indexes: DataFrame, columns: DataFrame,
                        constraints: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nested facts of each requested relation, as the assessment reads them.

    A server allows at most 1600 columns per relation and a definition lists
    few indexes and constraints, so the nested lists are bounded by the schema,
    not by the data.
    """
    none = F.lit(None)
    ix = indexes.groupBy("db_id", F.col("indrelid").alias("oid")).agg(F.array_sort(
        F.collect_list(F.struct(
            "name", "valid", known(none.cast("bigint")).alias("size_bytes"), "method", "partial",
            "has_expressions", "default_opclasses", "depends_on"))).alias("indexes"))
    col = columns.groupBy("db_id", F.col("attrelid").alias("oid")).agg(F.array_sort(
        F.collect_list(F.struct(
            F.col("attnum").cast("int").alias("place"), F.struct(
                F.col("attname").alias("name"), F.col("attnum").cast("int").alias("attnum"),
                "data_type", "not_null",
                F.col("default_expression").isNotNull().alias("has_default"),
                F.col("attidentity").alias("identity"), F.col("attgenerated").alias("generated"),
                "is_domain").alias("c")))).alias("k")).select(
        "db_id", "oid", F.col("k.c").alias("columns"))
    con = constraints.groupBy("db_id", F.col("conrelid").alias("oid")).agg(F.array_sort(
        F.collect_list(F.struct("name", "contype", "validated", "columns", "check_expression",
                                "referenced_table"))).alias("constraints"))
    size = sizes.select("db_id", "oid", "rel_bytes")
    joined = resolved
    for part in (ix, col, con, size):
        joined = joined.join(part, ["db_id", "oid"], "left")
    there, absent = F.col("exists"), F.lit("relation does not exist")

    def listed(name: str) -> Column:
        type_ = joined.schema[name].dataType.simpleString()
        return fact(there, F.coalesce(name, F.array().cast(type_)), absent, type_).alias(name)

    return joined.select("db_id", F.col("requested").alias("relation"), F.struct(
        known(there).alias("exists"), F.col("reltuples"), F.col("n_mod"), F.col("last_analyze"),
        F.col("last_autoanalyze"),
        fact(F.col("rel_bytes").isNotNull(), F.col("rel_bytes"), F.lit("size not gathered"),
             "bigint").alias("size_bytes"),
        listed("indexes"), listed("columns"), listed("constraints")).alias("facts"))


# --- functions and types ---------------------------------------------------------------
def function_facts(requested: DataFrame, pg_proc: DataFrame, pg_namespace: DataFrame) -> DataFrame:
    """Overloads of each requested function; facts count only when all agree.

    Names are spelled as for relations. An unqualified one matches any schema,
    as the search path of the later session is not known.
    """
    asked = requested.select("db_id", "function", own_part(F.col("function")).alias("proname"),
                             schema_part(F.col("function")).alias("schema"))
    procs = pg_proc.join(broadcast_if_small(pg_namespace.select(
        "db_id", F.col("oid").alias("pronamespace"), "nspname")), ["db_id", "pronamespace"])
    # overloads are folded first: one row per schema and name
    folded = procs.groupBy("db_id", "proname", "nspname").agg(
        F.count("*").alias("n"), F.min("provolatile").alias("v0"),
        F.max("provolatile").alias("v1"), F.min("prokind").alias("k0"),
        F.max("prokind").alias("k1"))
    hits = asked.join(folded, ["db_id", "proname"], "left").withColumn(
        "hit", F.col("n").isNotNull() & (F.col("schema").isNull()
                                         | (F.col("schema") == F.col("nspname"))))

    def agreed(low: str, high: str) -> Column:
        low_, high_ = F.min(F.when(F.col("hit"), F.col(low))), F.max(
            F.when(F.col("hit"), F.col(high)))
        return F.when(low_ == high_, low_)

    return hits.groupBy("db_id", "function").agg(
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("overloads"),
        agreed("v0", "v1").alias("volatility"), agreed("k0", "k1").alias("prokind")
    ).withColumn("exists", F.col("overloads") > 0)


def type_facts(starts: DataFrame, pg_type: DataFrame, pg_constraint: DataFrame) -> DataFrame:
    """Domain facts along the whole chain of each type.

    ``starts(db_id, type_oid)``. Returns the deepest base, the number of checks,
    whether any link is NOT NULL or carries a modifier, and the depth. All chains
    of a catalog are followed together, in as many rounds as the depth has bits.
    """
    checks = (pg_constraint.filter((F.col("contype") == "c") & F.col("contypid").isNotNull())
              .groupBy("db_id", F.col("contypid").alias("node")).agg(F.count("*").alias("checks")))
    is_domain = F.col("typtype") == "d"
    nodes = pg_type.select(
        "db_id", F.col("oid").alias("node"),
        F.when(is_domain & (F.col("typbasetype") != 0), F.col("typbasetype")).alias("next"),
        F.col("typnotnull").alias("not_null"),
        (is_domain & (F.col("typtypmod") != -1)).alias("has_typmod"),
        is_domain.alias("is_domain")).join(checks, ["db_id", "node"], "left")
    folded = fold_chains(nodes, ["db_id"], ["checks"], ["not_null", "has_typmod"])
    own = nodes.select("db_id", F.col("node").alias("type_oid"), "is_domain")
    asked = starts.select("db_id", "type_oid").distinct()
    return asked.join(own, ["db_id", "type_oid"]).join(
        folded.withColumnRenamed("node", "type_oid"), ["db_id", "type_oid"]).select(
        "db_id", "type_oid", "is_domain", F.col("last").alias("base_oid"), "not_null", "checks",
        "has_typmod", "depth")


def type_change_facts(requests: DataFrame, pg_type: DataFrame, pg_constraint: DataFrame,
                      pg_cast: DataFrame) -> DataFrame:
    """From and to facts of a type change; ``requests(db_id, request_id, cur_oid, new_oid)``."""
    both = requests.select("db_id", F.col("cur_oid").alias("type_oid")).unionByName(
        requests.select("db_id", F.col("new_oid").alias("type_oid"))).distinct()
    facts = type_facts(both, pg_type, pg_constraint)

    def side(prefix: str) -> DataFrame:
        return facts.select("db_id", F.col("type_oid").alias(f"{prefix}_oid"), *[
            F.col(c).alias(f"{prefix}_{c}") for c in
            ("is_domain", "base_oid", "not_null", "checks", "has_typmod")])

    casts = pg_cast.select("db_id", F.col("castsource").alias("cur_base_oid"),
                           F.col("casttarget").alias("new_base_oid"),
                           F.col("castmethod").alias("cast_method"))
    return (requests.join(side("cur"), ["db_id", "cur_oid"])
            .join(side("new"), ["db_id", "new_oid"], "left")
            .join(casts, ["db_id", "cur_base_oid", "new_base_oid"], "left")
            .withColumn("same_type", F.col("cur_oid") == F.col("new_oid"))
            .withColumn("bases_same", F.col("cur_base_oid") == F.col("new_base_oid")))


# --- activity ---------------------------------------------------------------------------
def lock_waiters(pg_locks: DataFrame, activity: DataFrame, own_pids: DataFrame) -> DataFrame:
    """Waiting locks with the modes their blockers hold on the same relation.

    ``pg_locks`` has ``blocking_pids`` on ungranted rows. The snapshot's own
    backend is left out on both sides. ``all_idle`` is NULL when a blocker's
    state is not known.
    """
    own = broadcast_if_small(own_pids.select("db_id", "pid"))
    locks = pg_locks.join(own, ["db_id", "pid"], "left_anti")
    held = locks.filter("granted").groupBy("db_id", "relation", "pid").agg(
        F.collect_set("mode").alias("modes"))  # a lock has eight modes
    waiting = locks.filter(~F.col("granted")).select(
        "db_id", "relation", F.col("pid").alias("blocked_pid"), F.col("mode").alias(
            "blocked_mode"), F.explode_outer("blocking_pids").alias("pid"))
    waiting = waiting.join(own.withColumn("__own", F.lit(True)), ["db_id", "pid"], "left"
                           ).withColumn("pid", F.when(F.col("__own").isNull(), F.col("pid"))
                                        ).drop("__own")
    blockers = waiting.join(held,
                            ["db_id", "relation", "pid"], "left").join(
        activity.select("db_id", "pid", "state"), ["db_id", "pid"], "left")
    known_state = F.col("pid").isNotNull() & F.col("state").isNotNull()
    idle = F.col("state").startswith("idle in transaction")
    return blockers.groupBy("db_id", "relation", "blocked_pid", "blocked_mode").agg(
        F.count("pid").alias("blockers"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("modes")))).alias(
            "blocking_modes"),
        F.when((F.count("pid") > 0) & (F.count_if(known_state) == F.count("pid")),
               F.bool_and(F.coalesce(idle, F.lit(True)))).alias("all_idle"))


def long_transactions(activity: DataFrame, threshold_ms: int, top: int) -> DataFrame:
    """The oldest open transactions of each database beyond a threshold.

    ``activity(db_id, pid, state, xact_age_ms, query, wait_event_type)``. Spark
    keeps only the top rows per database in every task before the shuffle.
    """
    masked, query = F.col("query").startswith("<"), F.ltrim(F.col("query"))
    keyword = F.lower(F.nullif(F.regexp_extract(query, r"^([A-Za-z]+)", 1), F.lit("")))
    old = activity.filter(F.col("xact_age_ms") >= threshold_ms)
    order = W.partitionBy("db_id").orderBy(F.desc("xact_age_ms"), "pid")
    return (old.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
            .select("db_id", "place", "pid", F.coalesce("state", F.lit("unknown")).alias("state"),
                    F.coalesce(F.col("state").startswith("idle in transaction"), F.lit(False)
                               ).alias("idle"), "xact_age_ms",
                    F.when(~F.coalesce(masked, F.lit(False)), keyword).alias("first_keyword"),
                    F.coalesce(F.col("wait_event_type") == "Lock", F.lit(False)
                               ).alias("waiting_on_lock")))


def connection_counts(activity: DataFrame, servers: DataFrame) -> DataFrame:
    """Client connections against the maximum; masked without the statistics privilege."""
    used = activity.groupBy("db_id").agg(
        F.count_if(F.col("backend_type") == "client backend").alias("n"))
    joined = servers.join(used, "db_id", "left")
    return joined.select("db_id", fact(F.col("can_read_stats"), F.coalesce("n", F.lit(0)),
                                       F.lit(MASKED), "bigint").alias("connections"),
                         "max_connections")


def replication_facts(servers: DataFrame, replicas: DataFrame) -> DataFrame:
    """Replica count and lags per server.

    A lag not reported yet is a known state; byte lag in recovery and masked
    details are unavailable.
    """
    lags = replicas.groupBy("db_id").agg(
        F.count("*").alias("replicas"), F.max("replay_lag_bytes").alias("lag_bytes"),
        F.count_if(F.col("replay_lag_bytes").isNull()).alias("unreported"),
        F.max("replay_lag_ms").alias("lag_ms"))
    joined = servers.join(lags, "db_id", "left")
    some = F.coalesce("replicas", F.lit(0)) > 0
    details = F.col("can_read_stats") & some
    why = F.when(~some, F.lit("no replicas")).when(~F.col("can_read_stats"), F.lit(MASKED)) \
        .when(F.col("in_recovery"), F.lit("server is in recovery")) \
        .otherwise(F.lit("not reported yet"))
    return joined.select(
        "db_id", some.alias("has_replicas"), F.coalesce("replicas", F.lit(0)).alias("replicas"),
        fact(details & ~F.col("in_recovery") & (F.col("unreported") == 0), F.col("lag_bytes"),
             why, "bigint").alias("lag_bytes"),
        fact(details, F.col("lag_ms"), why, "bigint").alias("lag_ms"))


def server_facts(settings: DataFrame) -> DataFrame:
    """Version, timeouts and time zone from ``settings(db_id, name, reset_val, unit)``.

    A timeout in an unexpected unit is unavailable.
    """
    names = ["server_version_num", "lock_timeout", "statement_timeout", "TimeZone"]
    row = F.struct("reset_val", "unit")
    wide = settings.filter(F.col("name").isin(*names)).groupBy("db_id").pivot(
        "name", names).agg(F.max(row))
    number = F.expr("try_cast(server_version_num.reset_val AS bigint)")

    def timeout(name: str) -> Column:
        ok = F.col(name).isNotNull() & F.coalesce(F.col(f"{name}.unit") == "ms", F.lit(True))
        return fact(ok, F.expr(f"try_cast({name}.reset_val AS bigint)"),
                    F.when(F.col(name).isNull(), F.lit("no settings row"))
                    .otherwise(F.lit("unexpected unit")), "bigint").alias(f"{name}_ms")

    return wide.select(
        "db_id", int_div(number, 10000).cast("int").alias("pg_version"),
        (number >= 140000).alias("has_wait_start"), timeout("lock_timeout"),
        timeout("statement_timeout"), F.col("TimeZone.reset_val").alias("time_zone"))


def calibration(readings: DataFrame) -> DataFrame:
    """The probe reading of each database: the least of its repeats."""
    return readings.groupBy("db_id").agg(F.min("compute_ms").alias("compute_ms"))


# --- comparison ----------------------------------------------------------------------------
def schema_differences(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a schema section that only one side has, duplicates kept.

    NULL equals NULL. One pass: both sides are counted per distinct row.
    """
    tagged = left.select(*columns, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*columns, F.lit(0).alias("l"), F.lit(1).alias("r")))
    counts = tagged.groupBy(*columns).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return counts.filter((F.col("l") == 0) | (F.col("r") == 0)).select(
        *columns, F.when(F.col("r") == 0, "left").otherwise("right").alias("only"),
        F.greatest("l", "r").alias("copies"))
