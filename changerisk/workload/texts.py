"""Text operators over documents, conversations, pages and events.

Statement texts are built from the rows of the given tables by a constant list
of forms, so the SQL side knows each form's answer and Spark has to find it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.functions import tagging, text, types, volatility
from changerisk.seeds import tables
from changerisk.workload.adapters import pick, pick_sql, table
from changerisk.workload.registry import query


def lit(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def listed(values: list, position: str) -> str:
    return f"([{', '.join(lit(v) for v in values)}])[({position}) + 1]"


def formed(forms: list[str], number: Column) -> Column:
    """The form a row's number selects, with ``#`` replaced by the number."""
    return F.replace(pick(forms, number % len(forms)), F.lit("#"), number.cast("string"))


# --- paths --------------------------------------------------------------------
PATHS = [
    ("./db/migrate/#_add.rb", "rails", "dsl"),
    ("svc\\billing\\db\\main\\migrate\\#.rb", "rails", "dsl"),
    ("/prisma/migrations/#_init/migration.sql", "prisma", "sql"),
    ("app/migrations/#_auto.py", "django", "dsl"), ("app/migrations/__init__.py", None, None),
    ("././alembic/versions/#.py", "alembic", "dsl"), ("sql/V#__create.sql", "flyway", "sql"),
    ("sql/R__views_#.sql", "flyway", "sql"), ("sql/Views__#.sql", None, None),
    ("deep/db/#_x.up.sql", "golang_migrate", "sql"),
    ("  migrations/a/#.sql ", "generic", "sql"), ("docs/#.md", None, None),
]
# A page's form of path is filled with the number in its url.
_URL_NO = "coalesce(nullif(regexp_extract(url, '://[^/]*/[a-z]+/([0-9]+)', 1), ''), '0')"
_RAW = f"replace({listed([p for p, _, _ in PATHS], f'page_id % {len(PATHS)}')}, '#', {_URL_NO})"
_URL_PATH = "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"
_NORMAL = ("regexp_replace(replace(trim(raw), chr(92), '/'), '^(\\./)*/*', '')")


@query("path_normalization", f"""
SELECT page_id, {_NORMAL} AS path, regexp_replace({_URL_PATH}, '^/+', '') AS url_path
FROM (SELECT page_id, url, {_RAW} AS raw FROM pages)""")
def path_normalization(spark, sf):
    url_path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    return table(spark, sf, "pages").select(
        "page_id", text.normalize_path(page_path()).alias("path"),
        text.normalize_path(url_path).alias("url_path"))


def page_path() -> Column:
    """The form of path that a page's id selects, filled with the number in its url."""
    number = F.coalesce(F.nullif(F.regexp_extract("url", "://[^/]*/[a-z]+/([0-9]+)", 1), F.lit("")),
                        F.lit("0"))
    return F.replace(pick([p for p, _, _ in PATHS], F.col("page_id") % len(PATHS)), F.lit("#"),
                     number)


@query("framework_tagging", f"""
SELECT page_id, {listed([f for _, f, _ in PATHS], f'page_id % {len(PATHS)}')} AS framework,
       {listed([k for _, _, k in PATHS], f'page_id % {len(PATHS)}')} AS source_kind FROM pages""")
def framework_tagging(spark, sf):
    path = text.normalize_path(page_path())
    found = text.framework_of(path)
    return table(spark, sf, "pages").select(
        "page_id", found["framework"].alias("framework"),
        found["source_kind"].alias("source_kind"))


@query("script_detection", f"""
WITH p AS (SELECT DISTINCT {_NORMAL} AS path FROM (SELECT {_RAW} AS raw FROM pages
           UNION ALL SELECT {_RAW} FROM pages WHERE page_id % 2 = 0))
SELECT path, CASE WHEN path LIKE 'prisma%' THEN 'prisma' WHEN path LIKE 'migrations/%' THEN
       'generic' WHEN path LIKE 'deep/%' THEN 'golang_migrate' WHEN path LIKE 'sql/V%__create.sql'
       OR path LIKE 'sql/R__%' THEN 'flyway' ELSE 'configured' END AS framework, 'sql' AS source_kind
FROM p WHERE (regexp_matches(path, '\\.sql$')) AND NOT regexp_matches(path, '^sql/V[0-9]*0__')""")
def script_detection(spark, sf):
    pages = table(spark, sf, "pages")
    raw = page_path().alias("path")
    twice = pages.select(raw).unionByName(pages.filter("page_id % 2 = 0").select(raw))
    return text.detect_scripts(twice, ["**/*.sql"], ["sql/V*0__*.sql"])


@query("changed_path_list", f"""
SELECT page_id, {_NORMAL} AS path FROM (
  SELECT page_id, CASE WHEN page_id % 4 = 1 THEN '   ' ELSE {_RAW} END AS raw FROM pages)
WHERE trim(raw) <> ''""")
def changed_path_list(spark, sf):
    from changerisk.sources.scripts import changed_paths

    raw = F.when(F.col("page_id") % 4 == 1, "   ").otherwise(page_path())
    lines = table(spark, sf, "pages").select("page_id", raw.alias("path"))
    normal = changed_paths(lines.select("path")).distinct()
    return lines.select("page_id", text.normalize_path(F.col("path")).alias("path")).join(
        normal, "path", "left_semi").select("page_id", "path")


# --- statements -----------------------------------------------------------------
SCRIPT = [
    ("BEGIN", "begin", None),
    ("CREATE TABLE IF NOT EXISTS app.t# (id int, note text DEFAULT 'a;b')", "create_table",
     "app.t#"),
    ("INSERT INTO t# VALUES (1, $$x;y$$), (2, $tag$;$tag$)", "insert", "t#"),
    ("-- trailing; comment\nCREATE UNIQUE INDEX CONCURRENTLY ix# ON t# USING btree (id)",
     "create_index_concurrently", "t#"),
    ("ALTER TABLE ONLY t# ADD COLUMN c int DEFAULT 0, ADD CHECK (id > 0)", "alter_table", "t#"),
    ("update T# set note = E'it\\'s; ok' where id between 1 and 5", "update_batched", "t#"),
    ('DELETE FROM "Odd;Name"', "delete_without_where", '"Odd;Name"'),
    ("WITH x AS (SELECT 1) SELECT * FROM x", "select", None),
    ("CREATE MATERIALIZED VIEW m# AS SELECT 1", "create_matview", "m#"),
    ("ALTER TYPE mood ADD VALUE 'new'", "alter_enum_add_value", "mood"),
    ("EXPLAIN SELECT 1", "other", None),
    ("DROP TABLE IF EXISTS a#, b#", "drop_table", "a#,b#"),
    ("COMMIT AND CHAIN", "commit", None),
]
_SOURCE_PARTS = [";\n".join(s for s, _, _ in SCRIPT[:7]), ";\n".join(s for s, _, _ in SCRIPT[7:])]


def script_source() -> Column:
    """A script around every document: its text is a comment in the middle."""
    def part(i: int) -> Column:
        return F.replace(F.lit(_SOURCE_PARTS[i]), F.lit("#"), F.col("doc_id").cast("string"))

    comment = F.replace(F.replace(F.col("text"), F.lit("*/"), F.lit("* /")), F.lit("/*"),
                        F.lit("/ *"))
    return F.concat(part(0), F.lit(";\n/* "), comment, F.lit(" */ "), part(1), F.lit(";\n"))


def scripts(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("file_id"), script_source().alias("source"))


def _line_sql(i: int) -> str:
    # newlines of the statements before, one per separator, plus those of the document
    before = sum(s.count("\n") + 1 for s, _, _ in SCRIPT[:i])
    own = 1 if i == 0 else before
    return f"{own} + CASE WHEN {i} > 7 THEN nl ELSE 0 END"


@query("statement_split_and_tag", """
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS file_id,
                  length(text) - length(replace(text, chr(10), '')) AS nl FROM documents)
""" + "\nUNION ALL\n".join(
    f"SELECT file_id, CAST({i} AS BIGINT) AS idx, {_line_sql(i)} AS line, {lit(kind)} AS kind, "
    f"replace({lit(target or '')}, '#', file_id) AS targets FROM d"
    for i, (_, kind, target) in enumerate(SCRIPT)))
def statement_split_and_tag(spark, sf):
    tagged = tagging.tag_statements(tagging.split_statements(scripts(spark, sf)))
    return tagged.select("file_id", "idx", "line", "kind",
                         F.array_join("targets", ",").alias("targets"))


# A document's own text stands in nested comments and in quotes; its comment signs are parted.
_PARTED = "replace(replace(replace(replace(text, '*/', '* /'), '/*', '/ *'), chr(39), ''), '$', '')"
_NESTED = (f"concat('SELECT 1 /* ', {_PARTED}, ' /* ', {_PARTED}, '; */ ; */ + 2;', chr(10),"
           f" 'SELECT $q$ /* ', {_PARTED}, ' $q$;', 'SELECT ', chr(39), '/* ;', chr(39),"
           f" ', 3 */* ; */4 -- /* ;', chr(10), '; DROP TABLE a /* /* /*;*/ ;*/ ', {_PARTED}, ';*/')")


@query("nested_comment_cuts", f"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, {_PARTED} AS t,
                  length(text) - length(replace(text, chr(10), '')) AS nl
           FROM documents WHERE text IS NOT NULL)
SELECT file_id, CAST(0 AS BIGINT) AS idx, CAST(1 AS BIGINT) AS line,
       md5('SELECT 1 + 2') AS sql_md5 FROM d
UNION ALL SELECT file_id, 1, 1 + 2 * nl, md5(concat('SELECT $q$ /* ', trim(regexp_replace(
       concat('/* ', t, ' $q$'), '[ \t\n\r\f\v]+', ' ', 'g'))[4:])) FROM d
UNION ALL SELECT file_id, 2, 2 + 3 * nl, md5('SELECT ''/* ;'', 3 * 4') FROM d
UNION ALL SELECT file_id, 3, 3 + 3 * nl, md5('DROP TABLE a') FROM d""")
def nested_comment_cuts(spark, sf):
    made = table(spark, sf, "documents").where("text IS NOT NULL").select(
        F.col("doc_id").cast("string").alias("file_id"), F.expr(_NESTED).alias("source"))
    return tagging.split_statements(made).select(
        "file_id", "idx", "line", F.md5(F.col("sql").cast("binary")).alias("sql_md5"))


ACTIONS = [
    # action, kind, column, type, constraint, referenced, partition
    ("ADD COLUMN c# int", "add_column", "c#", "int", None, None, None),
    ("ADD c# numeric(10, 2) NOT NULL", "add_column_not_null_no_default", "c#",
     "numeric(10, 2)", None, None, None),
    ("ADD COLUMN c# text NOT NULL DEFAULT NULL", "add_column_not_null_no_default", "c#", "text",
     None, None, None),
    ("ADD COLUMN c# uuid DEFAULT gen_random_uuid()", "add_column_default_volatile", "c#", "uuid",
     None, None, None),
    ("ADD COLUMN c# text DEFAULT my_fn('a, b')", "add_column_default_unknown_volatility", "c#",
     "text", None, None, None),
    ("ADD COLUMN c# timestamptz DEFAULT now()", "add_column_default_nonvolatile", "c#",
     "timestamptz", None, None, None),
    ("ADD COLUMN c# bigserial", "add_column_serial", "c#", "bigserial", None, None, None),
    ("ADD COLUMN c# int GENERATED BY DEFAULT AS IDENTITY", "add_column_identity", "c#", "int",
     None, None, None),
    ("ADD COLUMN c# int GENERATED ALWAYS AS (a + b) STORED", "add_column_generated_stored", "c#",
     "int", None, None, None),
    ("ADD COLUMN c# int GENERATED ALWAYS AS (a * 2) VIRTUAL", "add_column_generated_virtual",
     "c#", "int", None, None, None),
    ("ADD COLUMN c# int REFERENCES app.other (id)", "add_column", "c#", "int", None, "app.other",
     None),
    ("ADD CONSTRAINT k# FOREIGN KEY (a, b) REFERENCES p (x, y)", "add_foreign_key", None, None,
     "k#", "p", None),
    ("ADD CONSTRAINT k# FOREIGN KEY (a) REFERENCES p (x) NOT VALID", "add_foreign_key_not_valid",
     None, None, "k#", "p", None),
    ("ADD CONSTRAINT k# CHECK (length(a) > 0 AND b IN (1, 2))", "add_check", None, None, "k#",
     None, None),
    ("ADD CHECK (a > 0) NOT VALID", "add_check_not_valid", None, None, None, None, None),
    ("ADD PRIMARY KEY (id)", "add_primary_key", None, None, None, None, None),
    ("ADD CONSTRAINT k# PRIMARY KEY USING INDEX ix", "add_primary_key_using_index", None, None,
     "k#", None, None),
    ("ADD CONSTRAINT k# UNIQUE (a)", "add_unique", None, None, "k#", None, None),
    ("ADD CONSTRAINT k# UNIQUE USING INDEX ix", "add_unique_using_index", None, None, "k#", None,
     None),
    ("ADD CONSTRAINT k# NOT NULL a", "add_not_null_constraint", "a", None, "k#", None, None),
    ("ADD CONSTRAINT k# EXCLUDE USING gist (a WITH =, r WITH &&)", "add_exclusion", None, None,
     "k#", None, None),
    ("DROP COLUMN IF EXISTS c# CASCADE", "drop_column", "c#", None, None, None, None),
    ("DROP CONSTRAINT IF EXISTS k#", "drop_constraint", None, None, "k#", None, None),
    ("VALIDATE CONSTRAINT k#", "validate_constraint", None, None, "k#", None, None),
    ("ALTER COLUMN c# TYPE character varying(20) USING c#::text", "alter_column_type", "c#",
     "character varying(20)", None, None, None),
    ('ALTER "C#" SET DATA TYPE timestamp(3) with time zone', "alter_column_type", "C#",
     "timestamp(3) with time zone", None, None, None),
    ("ALTER COLUMN c# SET DEFAULT 0", "set_column_default", "c#", None, None, None, None),
    ("ALTER COLUMN c# DROP DEFAULT", "drop_column_default", "c#", None, None, None, None),
    ("ALTER COLUMN c# SET NOT NULL", "set_not_null", "c#", None, None, None, None),
    ("ALTER COLUMN c# DROP NOT NULL", "drop_not_null", "c#", None, None, None, None),
    ("ALTER COLUMN c# SET STATISTICS 500", "set_statistics", "c#", None, None, None, None),
    ("ALTER COLUMN c# SET EXPRESSION AS (a + 1)", "set_expression", "c#", None, None, None, None),
    ("ATTACH PARTITION part# FOR VALUES FROM (1) TO (2)", "attach_partition", None, None, None,
     None, "part#"),
    ("DETACH PARTITION part# CONCURRENTLY", "detach_partition_concurrently", None, None, None,
     None, "part#"),
    ("SET (fillfactor = 70)", "set_storage_params", None, None, None, None, None),
    ("OWNER TO someone", "change_owner", None, None, None, None, None),
    ("ENABLE ROW LEVEL SECURITY", "enable_row_security", None, None, None, None, None),
    ("DISABLE TRIGGER ALL", "disable_trigger", None, None, None, None, None),
    ("SET UNLOGGED", "set_unlogged", None, None, None, None, None),
    ("REPLICA IDENTITY FULL", "replica_identity", None, None, None, None, None),
]


def _alter_sql() -> Column:
    i, n = F.col("event_id"), len(ACTIONS)
    forms = [a for a, *_ in ACTIONS]
    return F.concat(F.lit("ALTER TABLE IF EXISTS s.t"), i.cast("string"), F.lit(" "),
                    formed(forms, i), F.lit(", "),
                    F.replace(pick(forms, (i * 3 + 1) % n), F.lit("#"), i.cast("string")))


def _field(j: int, position: str) -> str:
    return f"replace({listed([a[j] for a in ACTIONS], position)}, '#', CAST(event_id AS VARCHAR))"


def _action_select(place: int, position: str) -> str:
    names = ["kind", "column_name", "column_type", "constraint_name", "referenced_table",
             "partition_name"]
    cols = ", ".join(f"{_field(j + 1, position)} AS {name}" for j, name in enumerate(names))
    return f"SELECT event_id, {place} AS place, {cols} FROM events"


@query("alter_action_split", _action_select(0, f"event_id % {len(ACTIONS)}") + " UNION ALL "
       + _action_select(1, f"(event_id * 3 + 1) % {len(ACTIONS)}"))
def alter_action_split(spark, sf):
    actions = tagging.alter_actions(tagging.normalize(_alter_sql()))
    rows = table(spark, sf, "events").select("event_id", F.posexplode(actions).alias("place", "a"))
    return rows.select(
        "event_id", "place", "a.kind", F.col("a.column").alias("column_name"), "a.column_type",
        "a.constraint_name", "a.referenced_table", F.col("a.partition").alias("partition_name"))


_COLUMN_FORMS = [a for a in ACTIONS if a[1].startswith("add_column")]
_CONSTRAINT_FORMS = [a for a in ACTIONS if a[1].startswith("add_") and a not in _COLUMN_FORMS]


@query("add_column_forms", f"""
SELECT event_id, {listed([a[1] for a in _COLUMN_FORMS], f'event_id % {len(_COLUMN_FORMS)}')}
       AS kind FROM events""")
def add_column_forms(spark, sf):
    return table(spark, sf, "events").select("event_id", tagging.add_column_kind(
        formed([a[0] for a in _COLUMN_FORMS], F.col("event_id"))).alias("kind"))


@query("add_constraint_forms", f"""
SELECT event_id,
       {listed([a[1] for a in _CONSTRAINT_FORMS], f'event_id % {len(_CONSTRAINT_FORMS)}')}
       AS kind FROM events""")
def add_constraint_forms(spark, sf):
    return table(spark, sf, "events").select("event_id", tagging.add_constraint_kind(
        formed([a[0] for a in _CONSTRAINT_FORMS], F.col("event_id"))).alias("kind"))


DROPS = [
    ("DROP TABLE a#, app.b#", "drop_table", "a#,app.b#", False),
    ("DROP TABLE IF EXISTS a# CASCADE", "drop_table", "a#", True),
    ("DROP INDEX ix#", "drop_index", "ix#", False),
    ("DROP INDEX CONCURRENTLY IF EXISTS ix#", "drop_index_concurrently", "ix#", True),
    ("DROP MATERIALIZED VIEW m#", "drop_matview", "m#", False),
    ("DROP VIEW v1#, v2#", "drop_view", "v1#,v2#", False),
    ("DROP SEQUENCE IF EXISTS s#", "drop_sequence", "s#", True),
    ("DROP FUNCTION f(int)", "drop_function", "", False),
    ("DROP TYPE mood#", "drop_type", "", False),
    ("DROP TRIGGER tr ON t#", "drop_trigger", "", False),
    ("DROP OPERATOR CLASS x USING btree", "other", "", False),
    ("DROP ROUTINE r", "drop_function", "", False),
    ("DROP OWNED BY someone", "other", "", False),
]


@query("drop_forms", f"""
SELECT event_id, {listed([d[1] for d in DROPS], f'event_id % {len(DROPS)}')} AS kind,
       replace({listed([d[2] for d in DROPS], f'event_id % {len(DROPS)}')}, '#',
               CAST(event_id AS VARCHAR)) AS targets,
       {listed([d[3] for d in DROPS], f'event_id % {len(DROPS)}')} AS missing_ok FROM events""")
def drop_forms(spark, sf):
    sql = formed([d[0] for d in DROPS], F.col("event_id"))
    rows = table(spark, sf, "events").select("event_id", sql.alias("sql"))
    rows = rows.withColumn("kind", tagging.statement_kind(F.col("sql")))
    return rows.select("event_id", "kind", F.array_join(tagging.statement_targets(
        F.col("sql"), F.col("kind")), ",").alias("targets"),
        F.col("sql").rlike(r"(?i)\bIF EXISTS\b").alias("missing_ok"))


DML = [
    ("UPDATE t# SET a = 1", "update_without_where", ""),
    ("UPDATE t# SET a = 1 WHERE b = 'x'", "update", ""),
    ("UPDATE t# SET a = 1 WHERE id >= 10 AND id < 20", "update_batched", "key_window"),
    ("UPDATE t# SET a = 1 WHERE id >= 10 AND created < 20", "update", ""),
    ("UPDATE t# SET a = 1 WHERE id BETWEEN 1 AND 9", "update_batched", "key_window"),
    ("UPDATE t# SET a = 1 WHERE 10 <= id AND id < 20", "update_batched", "key_window"),
    ("DELETE FROM t#", "delete_without_where", ""),
    ("DELETE FROM t# WHERE created < now()", "delete", ""),
    ("DELETE FROM t# WHERE id IN (SELECT id FROM t# WHERE done LIMIT 1000)", "delete_batched",
     "limit"),
    ("DELETE FROM t# WHERE ctid = ANY (ARRAY(SELECT ctid FROM t# LIMIT 10))", "delete_batched",
     "limit,ctid"),
]


@query("dml_shapes", f"""
SELECT event_id, {listed([d[1] for d in DML], f'event_id % {len(DML)}')} AS kind,
       {listed([d[2] for d in DML], f'event_id % {len(DML)}')} AS signals FROM events""")
def dml_shapes(spark, sf):
    sql = formed([d[0] for d in DML], F.col("event_id"))
    signals = F.when(sql.rlike("WHERE"), F.array_join(tagging.batch_signals(sql), ","))
    return table(spark, sf, "events").select(
        "event_id", tagging.statement_kind(sql).alias("kind"),
        F.coalesce(signals, F.lit("")).alias("signals"))


GUARDS = [
    ("NOT EXISTS (SELECT 1 FROM pg_type WHERE typname = 'm#')", True),
    ("EXISTS (SELECT FROM information_schema.columns WHERE table_name = 't#')", True),
    ("to_regclass('public.t#') IS NULL", True), ("TO_REGTYPE('m#') IS NOT NULL", True),
    ("(SELECT count(*) FROM t#) > 0", False), ("true", False),
    ("x > 1 AND EXISTS (SELECT 1 FROM a JOIN pg_catalog.pg_class c ON true)", True),
    ("current_user = 'pg_class'", False),
]


@query("existence_guards", f"""
SELECT event_id, {listed([g for _, g in GUARDS], f'event_id % {len(GUARDS)}')} AS guarded,
       2 AS inner_statements FROM events""")
def existence_guards(spark, sf):
    condition = formed([g for g, _ in GUARDS], F.col("event_id"))
    body = F.concat(F.lit("DO $$ BEGIN IF "), condition, F.lit(
        " THEN CREATE TABLE t (id int); END IF; ALTER TABLE t ADD COLUMN c int; END $$"))
    tagged = tagging.tag_statements(table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("file_id"), F.lit(0).cast("bigint").alias("idx"),
        F.lit(1).cast("bigint").alias("line"), body.alias("sql")))
    inner = tagging.block_statements(tagged).filter("inner_pos > 0")
    return inner.groupBy(F.col("file_id").cast("bigint").alias("event_id")).agg(
        F.bool_or("conditional").alias("guarded"),
        F.count("*").cast("int").alias("inner_statements"))


# --- volatility ------------------------------------------------------------------
DEFAULTS = [
    ("0", "constant", ""), ("'now'::timestamptz", "constant", ""), ("now()", "stable", ""),
    ("CURRENT_TIMESTAMP", "stable", ""), ("gen_random_uuid()", "volatile", ""),
    ("lower('A')", "immutable", ""), ("1 + 2", "immutable", ""),
    ("my_fn(1)", "unknown", "my_fn"), ("app.f(g(2), lower('x'))", "unknown", "app.f,g"),
    ("coalesce(nextval('s'), 0)", "volatile", ""), ("('now'::text)::timestamptz", "immutable", ""),
    ("to_char(now(), 'YYYY')", "stable", ""), ("md5(random()::text)", "volatile", ""),
    ("my_fn(random())", "volatile", ""), ("'my_fn(1)'", "constant", ""),
    ("timezone('utc'::text, now())", "stable", ""), ("1 @@@ 2", "unknown", ""),
]
RESOLVED = ["constant", "constant", "stable", "stable", "volatile", "immutable", "immutable",
            "immutable", "unknown", "volatile", "immutable", "stable", "volatile", "volatile",
            "constant", "stable", "unknown"]


@query("default_volatility", f"""
SELECT event_id, {listed([d[1] for d in DEFAULTS], f'event_id % {len(DEFAULTS)}')} AS volatility,
       CASE WHEN {listed([d[1] for d in DEFAULTS], f'event_id % {len(DEFAULTS)}')} = 'unknown'
            THEN {listed([d[2] for d in DEFAULTS], f'event_id % {len(DEFAULTS)}')} ELSE '' END
         AS unknown_functions FROM events""")
def default_volatility(spark, sf):
    expression = pick([d[0] for d in DEFAULTS], F.col("event_id") % len(DEFAULTS))
    name = volatility.volatility_name(volatility.volatility_rank(expression))
    unknown = F.array_join(volatility.unknown_functions(expression), ",")
    return table(spark, sf, "events").select(
        "event_id", name.alias("volatility"),
        F.when(name == "unknown", unknown).otherwise("").alias("unknown_functions"))


@query("live_volatility", f"""
SELECT event_id, CASE WHEN event_id % 2 = 0
         THEN {listed(RESOLVED, f'event_id % {len(DEFAULTS)}')}
         ELSE {listed([d[1] for d in DEFAULTS], f'event_id % {len(DEFAULTS)}')} END AS volatility
FROM events""")
def live_volatility(spark, sf):
    expression = pick([d[0] for d in DEFAULTS], F.col("event_id") % len(DEFAULTS))
    static = volatility.volatility_name(volatility.volatility_rank(expression))
    # facts cover my_fn only on even rows, and wrongly claim lower() is volatile
    live = F.when(F.col("event_id") % 2 == 0, F.create_map(
        F.lit("my_fn"), F.lit(1), F.lit("lower"), F.lit(4))).otherwise(
        F.create_map(F.lit("lower"), F.lit(4)))
    return table(spark, sf, "events").select("event_id", volatility.decide_volatility(
        static, expression, live).alias("volatility"))


# --- types ------------------------------------------------------------------------
TYPES = [
    ("varchar(20)", "varchar", "20"), ("character  varying(20)", "varchar", "20"),
    ("NUMERIC(10, 2)", "numeric", "10,2"), ("decimal", "numeric", ""),
    ("timestamp(3) with time zone", "timestamptz", "3"), ("pg_catalog.int4", "int4", ""),
    ("text[]", None, None), ('"MyType"', None, None), ("time without time zone", "time", ""),
    ("bit varying(8)", "varbit", "8"), ("numeric(10)(2)", None, None), ("app.mood", None, None),
    ("char(3)", "bpchar", "3"), ("my_type", "my_type", ""),
]


@query("type_text_parsing", f"""
SELECT event_id, {listed([t[1] for t in TYPES], f'event_id % {len(TYPES)}')} AS base,
       {listed([t[2] for t in TYPES], f'event_id % {len(TYPES)}')} AS params FROM events""")
def type_text_parsing(spark, sf):
    parsed = types.parse_type(pick([t[0] for t in TYPES], F.col("event_id") % len(TYPES)))
    params = F.when(parsed.isNotNull(), F.coalesce(F.array_join(
        F.transform(parsed["params"], lambda p: p.cast("string")), ","), F.lit("")))
    return table(spark, sf, "events").select("event_id", parsed["name"].alias("base"),
                                             params.alias("params"))


@query("type_modifier_growth", """
WITH p AS (SELECT p_partkey, p_size AS a, CAST(p_partkey % 50 AS INT) AS b,
                  CAST(p_partkey % 4 AS INT) AS form FROM part)
SELECT p_partkey, CASE
  WHEN form = 0 THEN b >= a                                  -- varchar(a) to varchar(b)
  WHEN form = 1 THEN b >= a AND a % 3 = b % 3                -- numeric(a, s) to numeric(b, s)
  WHEN form = 2 THEN b % 8 >= 6                              -- timestamp to timestamp(b)
  ELSE false END AS allowed                                  -- varchar to varchar(b)
FROM p""")
def type_modifier_growth(spark, sf):
    a, b = F.col("p_size"), (F.col("p_partkey") % 50).cast("int")
    form = F.col("p_partkey") % 4
    base = F.when(form == 1, "numeric").when(form == 2, "timestamp").otherwise("varchar")
    current = F.when(form == 0, F.array(a)).when(form == 1, F.array(a, a % 3))
    new = F.when(form == 1, F.array(b, b % 3)).when(form == 2, F.array(b % 8)).otherwise(
        F.array(b))
    return table(spark, sf, "part").select("p_partkey", types.growth_allows(
        base, current, new).alias("allowed"))


CHECKS = [
    ("(c# IS NOT NULL)", True), ("((c# IS NOT NULL) AND (c# > 0))", True),
    ("(c# > 0)", False), ("((a > 0) AND ((c# IS NOT NULL)))", True),
    ("((c# IS NOT NULL) OR (a > 0))", False), ("(\"c#\" IS NOT NULL)", True),
    ("((a > 0) OR ((b > 0) AND (c# IS NOT NULL)))", False), ("c# is not null and d > 0", True),
    ("(length(c#) > 0)", False), ("(x# IS NOT NULL)", False),
]


@query("not_null_proof", f"""
SELECT event_id, {listed([c for _, c in CHECKS], f'event_id % {len(CHECKS)}')} AS proves
FROM events""")
def not_null_proof(spark, sf):
    expression = formed([c for c, _ in CHECKS], F.col("event_id"))
    column = F.concat(F.lit("c"), F.col("event_id").cast("string"))
    return table(spark, sf, "events").select(
        "event_id", text.proves_not_null(expression, column).alias("proves"))


# --- identifiers, secrets, rationales ------------------------------------------------
@query("identifier_quoting", """
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'app.' WHEN s_suppkey % 3 = 1 THEN '"App".'
                       ELSE '' END ||
       CASE WHEN s_suppkey % 2 = 0 THEN '"' || s_name || '"'
            WHEN s_suppkey % 5 = 0 THEN '"a""' || CAST(s_suppkey AS VARCHAR) || '"'
            ELSE 't' || CAST(s_suppkey AS VARCHAR) END AS name FROM supplier""")
def identifier_quoting(spark, sf):
    k = F.col("s_suppkey")
    schema = F.when(k % 3 == 0, "app").when(k % 3 == 1, "App")
    name = F.when(k % 2 == 0, F.col("s_name")).when(
        k % 5 == 0, F.concat(F.lit('a"'), k.cast("string"))).otherwise(
        F.concat(F.lit("t"), k.cast("string")))
    return table(spark, sf, "supplier").select(
        "s_suppkey", text.render_name(schema, name).alias("name"))


def _dsn() -> Column:
    return F.concat(F.lit("postgresql://deploy:pa%20ss"), F.col("doc_id").cast("string"),
                    F.lit("@db-"), F.col("doc_id").cast("string"),
                    F.lit(".internal:5432,replica:5433/orders_db?sslmode=require"))


@query("secret_redaction", """
SELECT doc_id, text || ' <redacted> and <redacted> on <redacted>; connection to server at '
       || '<redacted> failed: password=<redacted>, see <redacted> ' || text AS scrubbed
FROM documents""")
def secret_redaction(spark, sf):
    dsn, key = _dsn(), F.col("doc_id").cast("string")
    message = F.concat(
        F.col("text"), F.lit(" "), dsn, F.lit(" and pa ss"), key, F.lit(" on db-"), key,
        F.lit(".internal; connection to server at \"h"), key,
        F.lit("\" (10.0.0.4) failed: password='x y', see postgres://other/"), key, F.lit(" "),
        F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", text.scrub(message, text.secret_literals(dsn)).alias("scrubbed"))


@query("conversation_redaction", """
SELECT conv_id, turn, text || ' password=<redacted>; ok' AS scrubbed FROM conversations""")
def conversation_redaction(spark, sf):
    message = F.concat(F.col("text"), F.lit(" password = s3cret"),
                       F.col("conv_id").cast("string"), F.lit("; ok"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", text.scrub(message, F.array().cast("array<string>")).alias("scrubbed"))


@query("connection_string_split", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'deploy' ELSE 'ops' END AS user_name,
  CASE WHEN doc_id % 2 = 0 THEN 'pa ss' ELSE 'it''s ' END || CAST(doc_id AS VARCHAR) AS secret,
  CASE WHEN doc_id % 2 = 0 THEN 'db-' || CAST(doc_id AS VARCHAR) || '.internal' ELSE 'h' END
    AS host, CASE WHEN doc_id % 2 = 0 THEN 'replica' END AS host1,
  CASE WHEN doc_id % 2 = 0 THEN '5432' ELSE '6000' END AS port,
  CASE WHEN doc_id % 2 = 0 THEN 'orders_db' ELSE 'main' END AS dbname,
  CASE WHEN doc_id % 2 = 0 THEN 6 ELSE 2 END AS literals FROM documents""")
def connection_string_split(spark, sf):
    keywords = F.concat(F.lit("host=h port = 6000 user=ops dbname=main password='it\\'s "),
                        F.col("doc_id").cast("string"), F.lit("'"))
    dsn = F.when(F.col("doc_id") % 2 == 0, _dsn()).otherwise(keywords)
    rows = table(spark, sf, "documents").select("doc_id", dsn.alias("dsn"))
    rows = rows.withColumn("p", text.parse_conninfo(F.col("dsn")))

    def value(key: str) -> Column:
        return F.try_element_at("p", F.lit(key))

    return rows.select(
        "doc_id", value("user").alias("user_name"), value("password").alias("secret"),
        value("host").alias("host"), value("host1").alias("host1"), value("port").alias("port"),
        value("dbname").alias("dbname"),
        F.size(text.secret_literals(F.col("dsn"))).alias("literals"))


_PHRASES = [p for _, p in tables.RATIONALE_BUCKETS] + ["something else"]
_NAMES = [b for b, _ in tables.RATIONALE_BUCKETS] + ["other"]


@query("rationale_buckets", f"""
SELECT {listed(_NAMES, f'event_id % {len(_NAMES)}')} AS bucket, count(*) AS n
FROM events GROUP BY 1""")
def rationale_buckets(spark, sf):
    rationale = F.concat(F.lit("relation t: "), pick(_PHRASES, F.col("event_id") % len(_PHRASES)),
                         F.lit(" ("), F.col("event_type"), F.lit(")"))
    return table(spark, sf, "events").select(text.rationale_bucket(rationale).alias("bucket")
                                             ).groupBy("bucket").agg(F.count("*").alias("n"))
