"""Statement text to tagged statements, without a grammar.

A script is cut at the semicolons that lie outside quotes, dollar quotes and
comments. Each statement is tagged by its leading words and a few refinements;
whatever is not recognised is ``other``. All steps are native expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.functions.binding import let
from changerisk.functions.names import canonical
from changerisk.functions.volatility import unknown_functions, volatility_name, volatility_rank
from changerisk.seeds import literal_map, tables
from changerisk.seeds.forms import action_rows, form_rows

# One lexical token: quoted text, a comment, a semicolon, the body of a function from BEGIN
# ATOMIC to the END after a semicolon, or a run of the rest, which takes words whole (a dollar
# inside one opens no quote) and stops where a body begins. Loops over alternatives are
# possessive, which the matcher runs without recursion, so long scripts do not nest matches.
_LETTER = r"A-Za-z_\x{80}-\x{10FFFF}"
_TOKEN = (r"(?s)(?<![\w$][eE])(?<=[eE])'[^'\\]*+(?:\\.[^'\\]*+)*+'|'[^']*+'?|\"[^\"]*+\"?"
          r"|--[^\n]*+|",
          r"|(\$(?:[A-Za-z_]\w*+)?\$).*?\1|;"
          r"|(?i:\bBEGIN\s+ATOMIC\b(?:\s*END\b|.*?;\s*END\b))"
          rf"|(?:(?!(?i:BEGIN\s+ATOMIC\b))[{_LETTER}][$\d{_LETTER}]*+|[^-;'\"$/\d{_LETTER}]++|\d++)++"
          r"|.")
# A block comment and what it holds besides comments; one that holds others goes around them.
_HELD = r"/\*(?:[^*/]++|\*(?!/)|/(?!\*)"
#: Levels of block comments that are followed; what nests deeper counts as unclosed.
MAX_NESTING = 400
_CUT = "\u0001"
IDENT = r'(?:"(?:[^"]|"")+"|[A-Za-z_][\w$]*)'
NAME = rf"({IDENT}(?:\.{IDENT})*)"


def comment_depth(text: Column) -> Column:
    """At least as many levels as block comments nest in a text, and hardly more.

    Openers and closers are folded to the greatest depth; where two of them
    overlap (``*/*``) either may count, so each such place adds its two.
    """
    def step(at: Column, sign: Column) -> Column:
        now = F.greatest(at["now"] + F.when(sign == "/*", 1).otherwise(-1), F.lit(0))
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    signs = F.regexp_extract_all(text, F.lit(r"/\*|\*/"), F.lit(0))
    most = F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step,
                       lambda at: at["most"])
    overlaps = F.regexp_count(text, F.lit(r"/(?=\*/)|\*(?=/\*)"))
    return F.least(F.greatest(most + 2 * overlaps, F.lit(1)), F.lit(MAX_NESTING))


def lexical_tokens(text: Column) -> Column:
    """Tokens of a script, in order and without gaps; block comments nest."""
    def pattern(depth: Column) -> Column:
        return F.concat(F.lit(_TOKEN[0]), F.repeat(F.lit(_HELD + "|"), depth - 1), F.lit(_HELD),
                        F.lit(r")*+\*/"), F.repeat(F.lit(r")*+\*/"), depth - 1), F.lit(_TOKEN[1]))

    plain = F.replace(text, F.lit(_CUT), F.lit(" "))
    return F.regexp_extract_all(plain, pattern(comment_depth(plain)), F.lit(0))


def _cut(tokens: Column, keep_comments: bool) -> Column:
    def piece(t: Column) -> Column:
        out = F.when(t == ";", F.lit(_CUT))
        if not keep_comments:
            out = out.when(t.startswith("--") | t.startswith("/*"), F.lit(" "))
        return out.otherwise(t)

    return F.split(F.array_join(F.transform(tokens, piece), ""), _CUT)


def sums_before(values: Column) -> Column:
    """For every number of an array the sum of those before it.

    Sums run over blocks as long as there are blocks, so a list of n numbers
    takes n times the root of n additions and no shuffle.
    """
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, b: a + b)

    def in_blocks(vs: Column, side: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / side).cast("int")),
                             lambda k: total(F.slice(vs, k * side + 1, side)))
        return let(blocks, lambda bs: let(
            F.transform(bs, lambda _, k: total(F.slice(bs, F.lit(1), k))),
            lambda starts: F.transform(vs, lambda _, i: F.get(starts, F.floor(i / side).cast("int"))
                                       + total(F.slice(vs, i - i % side + 1, i % side)))))

    return let(values, lambda vs: F.when(F.size(vs) == 0, vs).otherwise(let(
        F.ceil(F.sqrt(F.size(vs).cast("double"))).cast("int"), lambda side: in_blocks(vs, side))))


def split_statements(scripts: DataFrame, text: str = "source") -> DataFrame:
    """One row per statement of ``scripts(file_id, source)``.

    Adds ``idx``, ``line`` (of the first character after the previous
    semicolon) and ``sql`` without comments, blanks squeezed. Block comments
    nest. A script is cut and numbered within its row, without a shuffle; an
    unclosed quote or comment counts as plain text from its sign on.
    """
    cut = scripts.select("file_id", lexical_tokens(F.col(text)).alias("__tokens")).select(
        "file_id", F.transform(_cut(F.col("__tokens"), True), lambda p: F.length(
            F.regexp_replace(p, r"[^\n]+", ""))).alias("__newlines"),
        F.transform(_cut(F.col("__tokens"), False), normalize).alias("__sql"))
    numbered = cut.select("file_id", F.posexplode(F.arrays_zip(
        F.col("__sql").alias("sql"), sums_before(F.col("__newlines")).alias("before"),
        sums_before(F.transform("__sql", lambda p: (p != "").cast("int"))).alias("idx"))
    ).alias("pos", "piece"))
    return numbered.where(F.col("piece.sql") != "").select(
        "file_id", F.col("piece.idx").cast("bigint").alias("idx"),
        (F.col("piece.before") + 1).cast("bigint").alias("line"), "piece.sql")


def normalize(sql: Column) -> Column:
    return F.trim(F.regexp_replace(sql, r"\s+", " "))


def _is(sql: Column, pattern: str) -> Column:
    return sql.rlike("(?i)" + pattern)


def _grab(sql: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, NULL when it does not match."""
    return F.nullif(F.regexp_extract(sql, "(?i)" + pattern, group), F.lit(""))


def fold_name(name: Column) -> Column:
    """A possibly qualified name as the server stores it: unquoted parts in lower case."""
    parts = F.regexp_extract_all(name, F.lit(f"({IDENT})"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(
        p.startswith('"'), F.replace(F.substr(p, F.lit(2), F.length(p) - 2), F.lit('""'),
                                     F.lit('"'))).otherwise(F.lower(p))), ".")


_MODIFIERS = (r"(?:(?:OR REPLACE|GLOBAL|LOCAL|TEMP|TEMPORARY|UNLOGGED|UNIQUE|RECURSIVE|TRUSTED|"
              r"CONSTRAINT(?= TRIGGER)) )*")
_OBJECT = (r"(MATERIALIZED VIEW|FOREIGN TABLE|FOREIGN DATA WRAPPER|EVENT TRIGGER|TEXT SEARCH|"
           r"DEFAULT PRIVILEGES|USER MAPPING|\w+)")


def statement_form(sql: Column) -> Column:
    """The verb, with its object class for CREATE, ALTER and DROP."""
    verb = F.upper(F.regexp_extract(sql, r"^([A-Za-z]+)", 1))
    object_class = F.upper(F.regexp_extract(
        sql, rf"(?i)^(?:CREATE|ALTER|DROP) {_MODIFIERS}{_OBJECT}", 1))
    return F.when(verb.isin("CREATE", "ALTER", "DROP"),
                  F.concat(verb, F.lit(" "), object_class)).otherwise(verb)


def batch_signals(sql: Column) -> Column:
    """Batching idioms of an UPDATE or DELETE with a WHERE clause.

    ``key_window`` needs one column bounded on both sides, or a BETWEEN.
    """
    where = F.coalesce(_grab(sql, r"\bWHERE\b(.*)$"), F.lit(""))
    column = r"([A-Za-z_][\w.]*)"
    operand = r"(?:[+-]?\d|'|\$|:|\()"

    def columns(pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(where, F.lit("(?i)" + pattern), F.lit(1)),
                           lambda c: F.substring_index(F.lower(c), ".", -1))

    lower = F.concat(columns(rf"{column}\s*>=?\s*[\w'$:(+-]"),
                     columns(rf"(?:\d|'|\))\s*<=?\s*{column}"))
    upper = F.concat(columns(rf"{column}\s*<=?\s*[\w'$:(+-]"),
                     columns(rf"(?:\d|'|\))\s*>=?\s*{column}"))
    window = (F.size(F.array_intersect(lower, upper)) > 0) | _is(
        where, rf"{column}\s+BETWEEN\s+{operand}")
    return F.array_compact(F.array(
        F.when(_is(sql, r"\(\s*SELECT\b.*\bLIMIT\b"), "limit"),
        F.when(_is(sql, r"\bctid\b"), "ctid"), F.when(window, "key_window")))


def probes_catalog(condition: Column) -> Column:
    """Does a guard's condition look at the system catalogs?"""
    catalogs = "|".join(tables.CATALOG_RELATIONS)
    functions = "|".join(tables.PROBE_FUNCTIONS)
    return (_is(condition, r"\b(?:from|join)\s+(?:information_schema|pg_catalog)\.")
            | _is(condition, rf"\b(?:from|join)\s+(?:{catalogs})\b")
            | _is(condition, rf"\b(?:{functions})\s*\("))


def statement_kind(sql: Column) -> Column:
    """Kind of a normalised statement; ``other`` when it is not recognised."""
    base = F.coalesce(F.try_element_at(literal_map(dict(form_rows())), statement_form(sql)),
                      F.lit("other"))
    return let(base, lambda b: _refined_kind(sql, b))


def _refined_kind(sql: Column, base: Column) -> Column:
    has_where = _is(sql, r"\bWHERE\b")
    batched = F.size(batch_signals(sql)) > 0

    def shaped(verb: str) -> Column:
        return F.when(~has_where, f"{verb}_without_where").when(
            batched, f"{verb}_batched").otherwise(verb)

    renames = _is(sql, r"^ALTER .*\bRENAME\b")
    renamed = (
        F.when(base == "alter_composite_type",
               F.when(_is(sql, r"\bRENAME VALUE\b"), "alter_enum_rename_value")
               .when(_is(sql, r"\bRENAME ATTRIBUTE\b"), "rename_other").otherwise("rename_type"))
        .when(_is(sql, r"\bRENAME CONSTRAINT\b"), F.when(base == "alter_table",
                                                         "rename_constraint")
              .otherwise("rename_other"))
        .when(~_is(sql, r"\bRENAME TO\b") & base.isin("alter_table", "alter_view",
                                                       "alter_matview", "alter_foreign_table"),
              "rename_column")
        .when(base == "alter_table", "rename_table").when(base == "alter_index", "rename_index")
        .when(base == "alter_view", "rename_view").when(base == "alter_matview", "rename_matview")
        .otherwise("rename_other"))
    return (
        F.when(base == "update", shaped("update")).when(base == "delete", shaped("delete"))
        .when((base == "select") & _is(sql, r"^WITH\b.*\)\s*INSERT INTO\b"), "insert")
        .when((base == "select") & _is(sql, r"^WITH\b.*\)\s*UPDATE\b"), shaped("update"))
        .when((base == "select") & _is(sql, r"^WITH\b.*\)\s*DELETE FROM\b"), shaped("delete"))
        .when((base == "select") & _is(sql, rf"^SELECT\b.*?\bINTO {IDENT}.*\bFROM\b"),
              "select_into")
        .when(_is(sql, r"^(?:PREPARE TRANSACTION|(?:COMMIT|ROLLBACK) PREPARED)\b"),
              "transaction_other")
        .when((base == "rollback") & _is(sql, r"^\w+ (?:WORK |TRANSACTION )?TO\b"),
              "rollback_to_savepoint")
        .when((base == "copy_from") & _is(sql, r"\bTO\b (?:STDOUT|PROGRAM|')"), "copy_to")
        .when((base == "vacuum") & _is(sql, r"^VACUUM (?:FULL\b|\([^)]*\bFULL\b(?! (?:false|off|0)))"),
              "vacuum_full")
        .when((base == "reindex") & _is(sql, r"^REINDEX [^;]*\bCONCURRENTLY\b"),
              "reindex_concurrently")
        .when((base == "refresh_matview") & _is(sql, r"\bCONCURRENTLY\b"),
              "refresh_matview_concurrently")
        .when((base == "create_index") & _is(sql, r"\bINDEX CONCURRENTLY\b"),
              "create_index_concurrently")
        .when((base == "drop_index") & _is(sql, r"\bINDEX CONCURRENTLY\b"),
              "drop_index_concurrently")
        .when((base == "create_table") & _is(sql, r"\bPARTITION OF\b"),
              "create_table_partition_of")
        .when((base == "create_table") & _is(
            sql, rf"^CREATE {_MODIFIERS}TABLE (?:IF NOT EXISTS )?{NAME}(?: \([^)]*\))?"
                 r"(?: (?:USING|WITH|TABLESPACE|ON COMMIT) [^()]*(?:\([^)]*\))?)* ?\bAS\b"),
              "create_table_as")
        .when(_is(sql, r"^CREATE TYPE \S+ AS ENUM\b"), "create_enum_type")
        .when(_is(sql, r"^CREATE TYPE \S+ AS RANGE\b"), "create_range_type")
        .when(_is(sql, r"^CREATE TYPE \S+ AS ?\("), "create_composite_type")
        .when((base == "alter_composite_type") & _is(sql, r"\bADD VALUE\b"),
              "alter_enum_add_value")
        .when(_is(sql, r"^ALTER .*\bSET SCHEMA\b"), "alter_object_schema")
        .when(renames & base.startswith("alter"), renamed)
        .when(_is(sql, r"^ALTER .*\bOWNER TO\b") & ~base.isin(
            "alter_table", "alter_index", "alter_view", "alter_matview", "alter_sequence",
            "alter_foreign_table"), "alter_owner")
        .otherwise(base)
    )


_SKIP = r"(?:CONCURRENTLY )?(?:IF (?:NOT )?EXISTS )?(?:ONLY )?"


def statement_targets(sql: Column, kind: Column) -> Column:
    """Relations a statement names as its object, as stored by the server."""
    listed = (rf"^(?:DROP (?:TABLE|INDEX|VIEW|MATERIALIZED VIEW|SEQUENCE)|TRUNCATE(?: TABLE)?"
              rf"|LOCK(?: TABLE)?) {_SKIP}({NAME}(?: ?\*)?(?: ?, ?{NAME})*)")
    on_table = rf" ON {_SKIP}{NAME}"
    single = (
        F.when(kind.isin("create_index", "create_index_concurrently", "create_policy",
                         "alter_policy", "create_trigger"), _grab(sql, on_table))
        .when(kind == "create_rule", _grab(sql, rf" TO {NAME}"))
        .when(kind == "insert", _grab(sql, rf"\bINSERT INTO {NAME}"))
        .when(kind.startswith("update"), _grab(sql, rf"\bUPDATE (?:ONLY )?{NAME}"))
        .when(kind.startswith("delete"), _grab(sql, rf"\bDELETE FROM (?:ONLY )?{NAME}"))
        .when(kind == "merge", _grab(sql, rf"^MERGE INTO (?:ONLY )?{NAME}"))
        .when(kind.isin("copy_from", "copy_to"), _grab(sql, rf"^COPY {NAME}"))
        .when(kind == "select_into", _grab(sql, rf"\bINTO (?:TABLE )?{NAME}"))
        .when(kind.startswith("vacuum") | (kind == "analyze"), _grab(
            sql, rf"^\w+ (?:\([^)]*\) ?)?(?:(?:FULL|FREEZE|VERBOSE|ANALYZE) )*{NAME}"))
        .when(kind == "cluster", _grab(sql, rf"^CLUSTER (?:VERBOSE )?{NAME}"))
        .when(kind.startswith("reindex"), _grab(
            sql, rf"^REINDEX (?:\([^)]*\) ?)?(?:INDEX|TABLE) (?:CONCURRENTLY )?{NAME}"))
        .when(kind.startswith("refresh"), _grab(
            sql, rf"^REFRESH MATERIALIZED VIEW (?:CONCURRENTLY )?{NAME}"))
        .when(kind.rlike("^(create|alter|rename)_") & ~kind.isin(
            "alter_role", "create_role", "alter_system", "alter_default_privileges",
            "create_schema", "create_extension", "alter_extension", "create_database",
            "alter_database", "create_tablespace", "alter_function", "alter_owner"),
            _grab(sql, rf"^(?:CREATE|ALTER) {_MODIFIERS}{_OBJECT} {_SKIP}{NAME}", 2))
    )
    many = F.transform(
        F.regexp_extract_all(_grab(sql, listed), F.lit(NAME), F.lit(1)), canonical)
    one = F.array_compact(F.array(canonical(single)))
    return F.when(kind.isin("drop_table", "drop_index", "drop_index_concurrently", "drop_view",
                            "drop_matview", "drop_sequence", "truncate", "lock_table"),
                  F.coalesce(many, F.array().cast("array<string>"))).otherwise(
        F.filter(F.coalesce(one, F.array().cast("array<string>")), lambda n: n != ""))


_LOCK_WORDS = {mode: level for mode, _, level, _ in tables.LOCK_MODES if 1 <= level <= 8}


def statement_attrs(sql: Column, kind: Column) -> Column:
    """The attributes rule conditions look at, as a map."""
    source = (F.when(_is(sql, r"\bDEFAULT VALUES\b"), "default_values")
              .when(_is(sql, r"\)? ?\bVALUES ?\("), "values").otherwise("select"))
    lock = F.coalesce(F.try_element_at(literal_map(_LOCK_WORDS), F.upper(_grab(
        sql, r"\bIN ([A-Z ]+?) MODE\b"))), F.lit(8))
    object_class = F.upper(F.replace(_grab(sql, rf"^ALTER {_OBJECT}"), F.lit(" "), F.lit("_")))
    def entry(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    def flag(pattern: str) -> Column:
        return F.when(_is(sql, pattern), "true").otherwise("false")

    fills = kind.isin("create_table_as", "create_matview", "refresh_matview")
    entries = F.filter(F.array(
        entry("source", F.when(kind == "insert", source)),
        entry("no_data", F.when(fills, flag(r"\bWITH NO DATA\b"))),
        entry("scope", F.when(kind.startswith("reindex"), F.lower(
            _grab(sql, r"^REINDEX (?:\([^)]*\) ?)?(\w+)")))),
        entry("mode", F.when(kind == "lock_table", lock.cast("string"))),
        entry("object_type", F.when(kind == "rename_other",
                                    F.concat(F.lit("OBJECT_"), object_class))),
        entry("chain", F.when(kind.isin("commit", "rollback"), flag(r"\bAND CHAIN\b"))),
    ), lambda e: e["value"].isNotNull())
    return F.map_from_entries(entries)


def split_top_level_commas(text: Column) -> Column:
    """Pieces of a list; commas inside parentheses or quotes do not split."""
    def opens(piece: Column, mark: str) -> Column:
        return F.length(piece) - F.length(F.replace(piece, F.lit(mark), F.lit("")))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("depth"),
                     F.lit(0).alias("quotes"))

    def step(acc: Column, piece: Column) -> Column:
        last = F.try_element_at(acc["parts"], F.lit(-1))
        head = F.slice(acc["parts"], F.lit(1), F.greatest(F.size(acc["parts"]) - 1, F.lit(0)))
        outside = (acc["depth"] == 0) & (acc["quotes"] % 2 == 0)
        return F.struct(
            F.when(outside, F.concat(acc["parts"], F.array(piece))).otherwise(
                F.concat(head, F.array(F.concat(last, F.lit(","), piece)))).alias("parts"),
            (acc["depth"] + opens(F.regexp_replace(piece, "'[^']*'", ""), "(")
             - opens(F.regexp_replace(piece, "'[^']*'", ""), ")")).alias("depth"),
            (acc["quotes"] + opens(piece, "'")).alias("quotes"))

    return F.transform(F.aggregate(F.split(text, ","), start, step, lambda acc: acc["parts"]),
                       lambda p: F.trim(p))


_TYPE = (r"((?:double precision|character varying|bit varying|char varying|"
         r"(?:timestamp|time)(?: ?\(\d+\))? with(?:out)? time zone|"
         rf"{IDENT}(?:\.{IDENT})*)(?: ?\([\d, ]*\))?(?: ?\[\d*\])*)")
_COLUMN_HEAD = rf"^ADD (?:COLUMN )?(?:IF NOT EXISTS )?({IDENT}) "


def add_column_kind(action: Column) -> Column:
    """Form of ADD COLUMN, the costliest property first."""
    return let(default_expression(action), lambda d: let(
        volatility_rank(d), lambda rank: _add_column_kind(action, d, rank)))


def _add_column_kind(action: Column, default: Column, rank: Column) -> Column:
    null_default = F.coalesce(_is(default, r"^(?:\()?NULL\b"), F.lit(False))
    not_null = _is(action, r"\bNOT NULL\b")
    serial = _is(action, _COLUMN_HEAD + r"(?:small|big)?serial[248]?\b")
    generated = _is(action, r"\bGENERATED ALWAYS AS ?\(")
    return (
        F.when(generated & ~_is(action, r"\bVIRTUAL\b"), "add_column_generated_stored")
        .when(generated, "add_column_generated_virtual")
        .when(_is(action, r"\bGENERATED (?:ALWAYS|BY DEFAULT) AS IDENTITY\b"),
              "add_column_identity")
        .when(serial, "add_column_serial")
        .when(default.isNotNull() & not_null & null_default, "add_column_not_null_no_default")
        .when(default.isNotNull() & (rank == 4), "add_column_default_volatile")
        .when(default.isNotNull() & (rank == 3), "add_column_default_unknown_volatility")
        .when(default.isNotNull(), "add_column_default_nonvolatile")
        .when(not_null, "add_column_not_null_no_default").otherwise("add_column"))


def default_expression(action: Column) -> Column:
    """Text of a DEFAULT clause up to the next column constraint."""
    return F.trim(_grab(action, r"\bDEFAULT (.+?)(?= (?:NOT NULL|NULL|CONSTRAINT|CHECK|UNIQUE|"
                                r"PRIMARY KEY|REFERENCES|COLLATE|GENERATED)\b|$)"))


def add_constraint_kind(action: Column) -> Column:
    """Form of ADD CONSTRAINT."""
    using, not_valid = _is(action, r"\bUSING INDEX\b"), _is(action, r"\bNOT VALID\b")
    body = F.regexp_replace(action, rf"(?i)^ADD (?:CONSTRAINT {IDENT} )?", "")

    def form(pattern: str) -> Column:
        return _is(body, "^" + pattern)

    return (
        F.when(form(r"PRIMARY KEY\b"),
               F.when(using, "add_primary_key_using_index").otherwise("add_primary_key"))
        .when(form(r"UNIQUE\b"), F.when(using, "add_unique_using_index").otherwise("add_unique"))
        .when(form(r"FOREIGN KEY\b"),
              F.when(not_valid, "add_foreign_key_not_valid").otherwise("add_foreign_key"))
        .when(form(r"CHECK\b"), F.when(not_valid, "add_check_not_valid").otherwise("add_check"))
        .when(form(r"NOT NULL\b"), F.when(not_valid, "add_not_null_constraint_not_valid")
              .otherwise("add_not_null_constraint"))
        .when(form(r"EXCLUDE\b"), "add_exclusion").otherwise("add_constraint_other"))


def action_kind(action: Column) -> Column:
    out = None
    for kind, pattern in action_rows():
        value = (add_column_kind(action) if kind == "add_column_form"
                 else add_constraint_kind(action) if kind == "add_constraint_form"
                 else F.lit(kind))
        test = _is(action, pattern)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise("other")


def parse_action(action: Column) -> Column:
    """One ALTER TABLE sub-action as a struct of the action schema."""
    return let(action_kind(action), lambda kind: _action_fields(action, kind))


def _action_fields(action: Column, kind: Column) -> Column:
    adds = kind.startswith("add_column")
    altered = _grab(action, rf"^(?:ALTER|DROP) (?:COLUMN )?(?:IF EXISTS )?({IDENT})")
    column = F.when(adds, _grab(action, rf"^ADD (?:COLUMN )?(?:IF NOT EXISTS )?({IDENT})")).when(
        kind.isin("drop_column", "alter_column_type", "set_column_default", "drop_column_default",
                  "set_not_null", "drop_not_null", "add_identity", "set_identity",
                  "drop_identity", "set_expression", "drop_expression", "set_statistics",
                  "set_storage", "set_compression"), altered).when(
        kind.startswith("add_not_null_constraint"), _grab(action, rf"\bNOT NULL ({IDENT})"))
    type_ = F.when(adds, _grab(action, _COLUMN_HEAD + _TYPE, 2)).when(
        kind == "alter_column_type", _grab(action, rf"\bTYPE {_TYPE}"))
    default = F.when(adds, default_expression(action)).when(
        kind == "set_column_default", _grab(action, r"\bSET DEFAULT (.+)$"))
    defaults = let(default, lambda d: F.struct(
        F.when(d.isNotNull(), volatility_name(volatility_rank(d))).alias("volatility"),
        d.alias("expression"),
        F.when(d.isNotNull(), unknown_functions(d)).alias("unknown")))
    return F.struct(
        kind.alias("kind"), fold_name(column).alias("column"), type_.alias("column_type"),
        fold_name(_grab(action, rf"\bCONSTRAINT (?:IF EXISTS )?({IDENT})")
                  ).alias("constraint_name"),
        _is(action, r"\bNOT NULL\b").alias("not_null"),
        _is(action, r"\bNOT VALID\b").alias("not_valid"),
        ((kind == "alter_column_type") & _is(action, r"\bUSING\b")).alias("has_using"),
        fold_name(_grab(action, rf"\bUSING INDEX ({IDENT})")).alias("using_index"),
        _is(action, r"\bIF (?:NOT )?EXISTS\b").alias("missing_ok"),
        canonical(_grab(action, rf"\bREFERENCES {NAME}")).alias("referenced_table"),
        canonical(_grab(action, rf"\b(?:ATTACH|DETACH) PARTITION {NAME}")).alias("partition"),
        defaults["volatility"].alias("default_volatility"),
        defaults["expression"].alias("default_expression"),
        defaults["unknown"].alias("unknown_functions"))


def alter_actions(sql: Column) -> Column:
    """The sub-actions of an ALTER TABLE in order."""
    rest = F.regexp_replace(
        sql, rf"(?i)^ALTER (?:FOREIGN )?TABLE (?:IF EXISTS )?(?:ONLY )?{IDENT}(?:\.{IDENT})* ?\*? ?",
        "")
    return F.transform(split_top_level_commas(rest), parse_action)


def tag_statements(statements: DataFrame) -> DataFrame:
    """Tag ``statements(file_id, idx, line, sql)`` to the statement schema."""
    sql, kind = F.col("sql"), F.col("kind")
    staged = statements.withColumn("kind", statement_kind(sql))
    return staged.select(
        "file_id", "idx", F.lit(0).alias("inner_pos"), "line", "kind", "sql",
        statement_targets(sql, kind).alias("targets"),
        F.when(kind == "alter_table", alter_actions(sql)).alias("actions"),
        statement_attrs(sql, kind).alias("attrs"),
        F.when(kind.startswith("create_table"), F.array_distinct(F.transform(
            F.regexp_extract_all(sql, F.lit(rf"(?i)\bREFERENCES {NAME}"), F.lit(1)), canonical))
               ).alias("referenced_tables"),
        canonical(_grab(sql, rf"\bPARTITION OF {NAME}")).alias("partition_of"),
        canonical(_grab(sql, rf"\bINDEX (?:CONCURRENTLY )?(?:IF NOT EXISTS )?({IDENT}) ON\b")
                  ).alias("index_name"),
        F.lower(F.coalesce(_grab(sql, r" ON .*?\bUSING (\w+)"), F.lit("btree"))
                ).alias("index_method"),
        (kind.startswith("create_index") & _is(sql, r" ON [^(]*\(.*[(].*\)")
         ).alias("has_expression"),
        canonical(_grab(sql, rf"\bRENAME (?:.*? )?TO ({IDENT})")).alias("new_name"),
        _is(sql, r"\bIF (?:NOT )?EXISTS\b").alias("missing_ok"),
        F.lit(False).alias("in_block"), F.lit(False).alias("conditional"),
        ((kind == "do_block") & _is(sql, r"\bEXECUTE\b")).alias("opaque"),
        F.lit(0).cast("bigint").alias("db_id"))


_CONTROL = (r"(?i)^(?:(?:DECLARE\b.*?\bBEGIN|BEGIN|ELSE|LOOP|IF\b.*?\bTHEN|ELSIF\b.*?\bTHEN|"
            r"(?:FOR|WHILE|FOREACH)\b.*?\bLOOP|EXCEPTION WHEN\b.*?\bTHEN|PERFORM)\s+)*")


def block_statements(tagged: DataFrame) -> DataFrame:
    """Add the inner statements of procedural blocks as rows of their own.

    Control words are dropped; an inner statement is ``conditional`` when a
    condition of its block looks for objects in the catalogs.
    """
    blocks = tagged.filter(F.col("kind") == "do_block")
    body = F.regexp_extract("sql", r"(?s)\$(\w*)\$(.*)\$\1\$", 2)
    conditions = F.regexp_extract_all(body, F.lit(r"(?i)\b(?:IF|ELSIF)\b(.*?)\bTHEN\b"),
                                      F.lit(1))
    inner = blocks.select(
        "file_id", "idx", "line", "db_id", F.exists(conditions, probes_catalog).alias("guard"),
        F.posexplode(F.split(body, ";")).alias("pos", "piece"))
    pieces = inner.select(
        "file_id", "idx", "line", "db_id", "guard", "pos",
        F.regexp_replace(F.trim("piece"), _CONTROL, "").alias("sql"))
    kinds = tag_statements(pieces.select(
        F.struct("file_id", "db_id", "guard", "pos").alias("file_id"), "idx", "line", "sql"))
    known = kinds.filter(~F.col("kind").isin("other", "begin", "commit", "rollback", "set"))
    flat = known.select(
        F.col("file_id.file_id").alias("file_id"), "idx",
        (F.col("file_id.pos") + 1).cast("int").alias("inner_pos"),
        *[c for c in kinds.columns if c not in ("file_id", "idx", "inner_pos", "in_block",
                                                "conditional", "db_id")],
        F.lit(True).alias("in_block"), F.col("file_id.guard").alias("conditional"),
        F.col("file_id.db_id").alias("db_id"))
    return tagged.unionByName(flat)
