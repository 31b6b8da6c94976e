"""State that depends on the order of statements inside a file.

All of it runs through :func:`prefix_scan` or plain grouped minima, so a file
that holds a large share of all statements is worked on by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.functions.binding import record
from changerisk.functions.durations import int_div
from changerisk.functions.names import last_spelled
from changerisk.operators.distribution import CHUNK_ROWS, prefix_scan
from changerisk.seeds import tables
from changerisk.session import broadcast_if_small, cut_lineage


def _chunk(idx: str = "idx") -> Column:
    return int_div(F.col(idx), CHUNK_ROWS)


# --- transactions ------------------------------------------------------------
def _marks_of_blocks() -> tuple[Column, Column, Column]:
    """Openers, closers, and closers that chain into a new block."""
    kind, top = F.col("kind"), F.col("inner_pos") == 0
    chained = F.coalesce(F.try_element_at("attrs", F.lit("chain")) == "true", F.lit(False))
    return (kind == "begin") & top, kind.isin("commit", "rollback") & top, chained


def transaction_state(statements: DataFrame) -> DataFrame:
    """Add ``explicit`` and ``block_id`` in one scan.

    A block is open when the last opener or unchained closer before the
    statement is an opener (a chained close leaves it as it is). Statements of
    one explicit block share the closer before them, which is ``block_id``.
    """
    begins, closes, chained = _marks_of_blocks()
    scanned = prefix_scan(statements, ["file_id"], ["idx", "inner_pos"], _chunk(), {
        "__open": ("last", F.when(begins, 1).when(closes & ~chained, 0)),
        "__closer": ("max", F.when(closes, F.col("idx")))})
    return scanned.select(
        *statements.columns,
        (F.coalesce(F.col("__open") == 1, F.lit(False)) & ~begins & ~closes).alias("explicit"),
        F.coalesce("__closer", F.lit(-1).cast("bigint")).alias("block_id"))


def transaction_groups(statements: DataFrame) -> DataFrame:
    """Add the transaction each statement runs in.

    ``inside`` tells whether an explicit block is open before the statement,
    ``group_no`` counts the boundaries passed, ``explicit`` marks statements
    of an explicit block and ``warning`` names stray marks. AND CHAIN reopens
    a block only when one was open, so it leaves ``inside`` as it is.
    """
    begins, closes, chained = _marks_of_blocks()
    mark = F.when(begins, 1).when(closes & ~chained, 0)
    # Known before the scans, which need not carry the attributes then.
    chunked = statements.withColumns({"__part": _chunk(), "__chained": closes & chained})
    order = ["idx", "inner_pos"]
    scanned = prefix_scan(chunked, ["file_id"], order, "__part", {"__open": ("last", mark)})
    inside = F.coalesce(F.col("__open") == 1, F.lit(False))
    boundary = (begins & ~inside) | (closes & inside)
    staged = scanned.select(*statements.columns, "__part", "__chained", inside.alias("inside"),
                            boundary.cast("bigint").alias("__boundary"))
    numbered = prefix_scan(staged, ["file_id"], order, "__part",
                           {"__before": ("sum", F.col("__boundary"))})
    before = F.coalesce(F.col("__before"), F.lit(0).cast("bigint"))
    return numbered.select(
        *statements.columns, "inside",
        # an opener belongs to the block it opens, a closer to the one it closes
        (before + F.when(begins, F.col("__boundary")).otherwise(0)).alias("group_no"),
        (F.col("inside") & ~closes & ~begins).alias("explicit"),
        F.when(begins & F.col("inside"), "begin inside an open block")
        .when(closes & ~F.col("inside"), "no block to close").alias("warning"),
        (F.col("__boundary") == 1).alias("is_boundary"), F.col("__chained").alias("chained"),
    )


def transaction_summary(grouped: DataFrame) -> DataFrame:
    """One row per transaction group that has an opener or statements.

    A chained close also opens the next group.
    """
    kind = F.col("kind")
    grouped = grouped.filter(F.col("inner_pos") == 0)
    own = grouped.select("file_id", "group_no", "idx", "kind", "is_boundary",
                         F.lit(False).alias("by_chain"), "explicit")
    reopened = (grouped.filter(F.col("is_boundary") & F.col("chained"))
                .select("file_id", (F.col("group_no") + 1).alias("group_no"), "idx", "kind",
                        F.lit(True).alias("is_boundary"), F.lit(True).alias("by_chain"),
                        F.lit(True).alias("explicit")))
    rows = own.unionByName(reopened)
    marks = kind.isin("begin", "commit", "rollback")
    opens = F.col("is_boundary") & ((kind == "begin") | F.col("by_chain"))
    closes = F.col("is_boundary") & (kind != "begin") & ~F.col("by_chain")
    out = rows.groupBy("file_id", "group_no").agg(
        F.count_if(~marks).alias("statements"),
        F.min(F.when(opens, F.col("idx"))).alias("opened_by"),
        F.min(F.when(closes, F.col("idx"))).alias("closed_by"),
        F.coalesce(F.bool_or(closes & (kind == "rollback")), F.lit(False)).alias("rolled_back"),
    )
    return (out.filter((F.col("statements") > 0) | F.col("opened_by").isNotNull())
            .withColumn("explicit", F.col("opened_by").isNotNull())
            .withColumn("never_closed", F.col("explicit") & F.col("closed_by").isNull()))


# --- baseline files ----------------------------------------------------------
def baseline_files(statements: DataFrame) -> DataFrame:
    """Files that create everything they touch: ``file_id``, ``baseline``.

    A name is fine when it is first created before it is first referenced, so
    two grouped minima per (file, name) decide it. A reference needs a create
    in an earlier statement, a partition's parent may be created by the same.
    """
    kind = F.col("kind")
    top = statements.filter(F.col("inner_pos") == 0)
    position = F.col("idx") * 2
    dropped = kind.isin(*tables.DROPS_RELATION) & ~F.coalesce(F.col("missing_ok"), F.lit(False))
    creates = kind.isin(*tables.CREATES_RELATION)
    refers = kind.isin(*tables.REFERENCES_RELATION) | dropped
    none = F.lit(None).cast("bigint")

    def event(name: Column, created: Column, used: Column) -> Column:
        return F.struct(last_spelled(name).alias("name"),
                        created.alias("created"), used.alias("used"))

    targets = F.transform(F.coalesce("targets", F.array().cast("array<string>")), lambda t: event(
        t, F.when(creates, position), F.when(refers & ~creates, position)))
    extra = F.array_compact(F.array(
        F.when(creates & F.col("partition_of").isNotNull(),
               event(F.col("partition_of"), none, position + 1)),
        F.when(refers & kind.isin("create_index", "create_index_concurrently")
               & F.col("index_name").isNotNull(), event(F.col("index_name"), position + 1, none)),
        F.when(refers & kind.isin("rename_table", "rename_column")
               & F.col("new_name").isNotNull(), event(F.col("new_name"), position + 1, none)),
    ))
    names = (top.select("file_id", F.explode(F.concat(targets, extra)).alias("e"))
             .groupBy("file_id", F.col("e.name").alias("name"))
             .agg(F.min("e.created").alias("created"), F.min("e.used").alias("used")))
    settled = names.groupBy("file_id").agg(F.bool_and(
        F.col("used").isNull() | F.coalesce(F.col("created") < F.col("used"), F.lit(False))
    ).alias("settled"))
    counts = top.groupBy("file_id").agg(F.count("*").alias("statements"))
    return counts.join(settled, "file_id", "left").select("file_id", "statements", (
        (F.col("statements") >= tables.BASELINE_MIN_STATEMENTS)
        & F.coalesce(F.col("settled"), F.lit(True))).alias("baseline"))


# --- relations a file created ------------------------------------------------
def _marks(statements: DataFrame) -> DataFrame:
    """Events that change what a file has created, one row per (file, name)."""
    kind = F.col("kind")
    first = F.try_element_at("targets", F.lit(1))
    source = F.try_element_at("attrs", F.lit("source"))
    bounded = (kind == "insert") & F.coalesce(source.isin("values", "default_values"),
                                              F.lit(False))

    def event(name: Column, what: Column | str, old: Column | None = None) -> Column:
        return F.struct(last_spelled(name).alias("name"),
                        (F.lit(what) if isinstance(what, str) else what).alias("what"),
                        (F.lit(None).cast("string") if old is None else old).alias("old_name"))

    none = F.array().cast("array<struct<name:string,what:string,old_name:string>>")
    old = last_spelled(first)
    events = (
        F.when(kind.isin("create_table", "create_table_partition_of"),
               F.array(event(first, "clean")))
        .when(kind.isin("create_table_as", "select_into", "create_matview"),
              F.array(event(first, "loaded")))
        .when(kind == "drop_table", F.transform("targets", lambda t: event(t, "none")))
        .when((kind == "rename_table") & F.col("new_name").isNotNull()
              & (old != last_spelled(F.col("new_name"))),
              F.array(event(first, "renamed_away"), event(F.col("new_name"), "renamed", old)))
        .when(kind.isin("copy_from", "merge") | ((kind == "insert") & ~bounded),
              F.array(event(first, "load")))
        .otherwise(none)
    )
    return (statements.select("file_id", "idx", "inner_pos", F.explode(events).alias("e"))
            .filter(F.col("e.name").isNotNull())
            .select("file_id", "idx", "inner_pos", "e.*"))


def created_state(statements: DataFrame, requests: DataFrame) -> DataFrame:
    """State of the requested names just before their statement runs.

    ``requests`` holds ``file_id, idx, inner_pos, name`` (unqualified) and any
    other columns; they are returned with ``state``: ``clean`` (created empty
    in this file), ``loaded`` (bulk-loaded since) or NULL. Inner statements of
    a block see the state before the block.

    Each name is scanned on its own. Renames point at the old name's state,
    so they are resolved apart: one pass per link of the longest rename
    chain, each over the rename rows only.
    """
    marks = _marks(statements)
    extra = [c for c in requests.columns if c not in ("file_id", "idx", "inner_pos", "name")]
    # what each rename reads: the old name's state and the new name's own
    reads = marks.filter(F.col("what") == "renamed").select(
        "file_id", "idx", "inner_pos", F.col("name").alias("new_name"),
        (2 * F.col("inner_pos") + 1).alias("at"), F.explode(F.array(
            record(pointer=F.lit("old"), name=F.col("old_name")),
            record(pointer=F.lit("new"), name=F.col("name")))).alias("read")
    ).select("*", "read.*").drop("read")
    seen = cut_lineage(_scan_marks(marks, requests.withColumn("at", F.lit(0)).unionByName(
        reads, allowMissingColumns=True), [*extra, "new_name", "pointer"]))
    resolved = _resolve_renames(seen.filter(F.col("pointer").isNotNull())).select(
        "file_id", F.col("new_name").alias("name"), F.col("idx").alias("from_idx"),
        F.col("inner_pos").alias("from_pos"), F.col("state").alias("renamed_state"))

    asked = seen.filter(F.col("pointer").isNull())
    joined = asked.join(broadcast_if_small(resolved),
                        ["file_id", "name", "from_idx", "from_pos"], "left")
    state = F.when(F.col("state") != "renamed", F.col("state")).when(
        F.col("renamed_state").isNotNull(),
        F.when(F.col("loaded_since"), "loaded").otherwise(F.col("renamed_state")))
    return joined.select("file_id", "idx", "inner_pos", "name", *extra, state.alias("state"))


def _scan_marks(marks: DataFrame, requests: DataFrame, extra: list[str]) -> DataFrame:
    """The latest origin of each requested name; ``at`` orders rows of one statement."""
    rows = (marks.withColumn("at", 2 * F.col("inner_pos") + 2)
            .withColumn("is_mark", F.lit(True))
            .unionByName(requests.withColumn("is_mark", F.lit(False)),
                         allowMissingColumns=True))
    what = F.col("what")
    scanned = prefix_scan(rows, ["file_id", "name"], ["idx", "at"], _chunk(), {
        "origin": ("last", F.when(what.isNotNull() & (what != "load"),
                                  F.struct("what", "idx", "inner_pos"))),
        "load_at": ("max", F.when(what == "load", F.struct("idx", "inner_pos"))),
    })
    loaded = F.coalesce(F.col("load_at") > F.struct(F.col("origin.idx").alias("idx"),
                                                     F.col("origin.inner_pos").alias("inner_pos")),
                        F.lit(False))
    origin = F.col("origin.what")
    return scanned.filter(~F.col("is_mark")).select(
        "file_id", "idx", "inner_pos", "name", *extra,
        F.when(origin == "clean", F.when(loaded, "loaded").otherwise("clean"))
        .when(origin.isin("loaded", "renamed"), origin).alias("state"),
        loaded.alias("loaded_since"), F.col("origin.idx").alias("from_idx"),
        F.col("origin.inner_pos").alias("from_pos"),
    )


def _resolve_renames(pointers: DataFrame) -> DataFrame:
    """State each rename gives its new name.

    The old name's state moves over; a rename of something the file did not
    create leaves the new name as it was.
    """
    keys = ["file_id", "idx", "inner_pos", "new_name"]

    def side(pointer: str) -> list[Column]:
        def only(value: Column, name: str) -> Column:
            return F.max(F.when(F.col("pointer") == pointer, value)).alias(f"{pointer}_{name}")

        state = F.col("state")
        is_open = F.coalesce(state == "renamed", F.lit(False))
        return [only(F.col("name"), "ref"), only(F.when(~is_open, state), "state"),
                only(is_open, "open"), only(F.col("loaded_since"), "loaded"),
                only(F.col("from_idx"), "idx"), only(F.col("from_pos"), "pos")]

    table = (pointers.groupBy(*keys).agg(*side("old"), *side("new"))
             .withColumn("done", F.lit(False)).withColumn("state", F.lit(None).cast("string")))
    while True:
        settled = ~F.col("old_open") & (F.col("old_state").isNotNull() | ~F.col("new_open"))
        table = table.withColumn("done", F.col("done") | settled).withColumn(
            "state", F.when(F.col("done"), F.coalesce("old_state", "new_state")))
        table = cut_lineage(table)
        if table.filter(~F.col("done")).isEmpty():
            return table.select(*keys, "state")
        done = table.filter(F.col("done")).select(
            "file_id", F.col("new_name").alias("ref"), F.col("idx").alias("ref_idx"),
            F.col("inner_pos").alias("ref_pos"), F.col("state").alias("ref_state"),
            F.lit(True).alias("hit"))
        for name in ("old", "new"):
            follow = [F.col("t.file_id") == F.col("d.file_id"),
                      F.col(f"t.{name}_ref") == F.col("d.ref"),
                      F.col(f"t.{name}_idx") == F.col("d.ref_idx"),
                      F.col(f"t.{name}_pos") == F.col("d.ref_pos"), F.col(f"t.{name}_open")]
            hit = F.coalesce(F.col("d.hit"), F.lit(False))
            value = F.when(F.col("d.ref_state").isNotNull(),
                           F.when(F.col(f"t.{name}_loaded"), "loaded")
                           .otherwise(F.col("d.ref_state")))
            table = table.alias("t").join(done.alias("d"), follow, "left").select(
                *[F.col(f"t.{c}") for c in table.columns
                  if c not in (f"{name}_state", f"{name}_open")],
                F.when(hit, value).otherwise(F.col(f"t.{name}_state")).alias(f"{name}_state"),
                (F.col(f"t.{name}_open") & ~hit).alias(f"{name}_open"))


def _opens_block() -> Column:
    return (F.col("statement_kind") == "begin") & (F.col("inner_pos") == 0)


# --- locks held across statements ---------------------------------------------
def held_locks(units: DataFrame) -> DataFrame:
    """Locks an explicit transaction already holds before each of its statements.

    ``units`` carry ``file_id, idx, block_id, explicit, locks``. Returns one row
    per statement of an explicit block with the number of earlier acquisitions,
    the strongest level among them and whether one of them blocks writers.
    """
    taken = F.filter("locks", lambda k: k["certain"] & k["level"].between(3, 8))
    statements = (
        units.filter(F.col("explicit"))
        .select("file_id", "idx", "block_id", F.size(taken).alias("n"),
                F.array_max(F.transform(taken, lambda k: k["level"])).alias("level"))
        .groupBy("file_id", "block_id", "idx")
        .agg(F.sum("n").cast("bigint").alias("acquired"), F.max("level").alias("strongest"))
    )
    scanned = prefix_scan(statements, ["file_id", "block_id"], ["idx"], _chunk(), {
        "held": ("sum", F.col("acquired")), "held_level": ("max", F.col("strongest"))})
    return scanned.select(
        "file_id", "block_id", "idx", F.coalesce("held", F.lit(0)).alias("held"),
        F.coalesce("held_level", F.lit(0)).alias("held_level"),
        (F.coalesce("held_level", F.lit(0)) >= 5).alias("blocking_held"))


def exclusive_accumulation(units: DataFrame) -> DataFrame:
    """Relations locked ACCESS EXCLUSIVE together: one row per relation.

    A group is reported when it locks two relations or more. Files without any
    explicit group are reported as a whole (``hypothetical``), as a runner that
    wraps the file in one transaction would accumulate all of them.
    """
    locks = (
        units.filter(~F.col("conditional"))
        .select("file_id", "idx", "block_id", "explicit", F.explode("locks").alias("lock"))
        .filter(F.col("lock.certain") & (F.col("lock.level") == 8)
                & F.col("lock.relation").isNotNull())
        .groupBy("file_id", "block_id", "explicit", F.col("lock.relation").alias("relation"))
        .agg(F.min("idx").alias("since"))
    )
    in_group = locks.filter("explicit").select(
        "file_id", "block_id", "relation", "since", F.lit(False).alias("hypothetical"))
    wrapped_files = (units.groupBy("file_id").agg(F.bool_or(_opens_block()).alias("e"))
                     .filter(~F.col("e")).select("file_id"))
    whole = (locks.join(wrapped_files, "file_id", "left_semi")
             .groupBy("file_id", "relation").agg(F.min("since").alias("since"))
             .select("file_id", F.lit(-1).cast("bigint").alias("block_id"), "relation", "since",
                     F.lit(True).alias("hypothetical")))
    held = in_group.unionByName(whole)
    sizes = (held.groupBy("file_id", "block_id", "hypothetical")
             .agg(F.count("*").alias("relations")).filter(F.col("relations") >= 2))
    return held.join(sizes, ["file_id", "block_id", "hypothetical"])


def unwrappable_files(units: DataFrame) -> DataFrame:
    """Files with a transaction-forbidden statement and no explicit transaction."""
    forbidden = (F.col("rule.txn") == "forbidden") & ~F.col("explicit") & ~F.col("in_block")
    return (units.groupBy("file_id")
            .agg(F.bool_or(F.coalesce(forbidden, F.lit(False))).alias("forbidden"),
                 F.bool_or(_opens_block()).alias("has_explicit"))
            .filter(F.col("forbidden") & ~F.col("has_explicit")).select("file_id"))


# --- replay order -------------------------------------------------------------
def replay_order(files: DataFrame) -> DataFrame:
    """Position of each ``repo__number__name`` script inside its repository.

    ``earlier`` counts the scripts that run before it and ``previous`` names
    the last of them.
    """
    parts = F.split("file_name", "__", 3)
    ordered = files.select(
        "*", F.get(parts, F.lit(0)).alias("repo"),
        F.expr("try_cast(get(split(file_name, '__', 3), 1) AS bigint)").alias("number"))
    ordered = ordered.filter(F.col("number").isNotNull())
    scanned = prefix_scan(ordered, ["repo"], ["number", "file_name"],
                          int_div(F.col("number"), 1024), {
                              "earlier": ("sum", F.lit(1).cast("bigint")),
                              "previous": ("last", F.col("file_name"))})
    return scanned.withColumn("earlier", F.coalesce("earlier", F.lit(0)))
