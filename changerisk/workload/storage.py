"""Sources and sinks over files written from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changerisk import seeds
from changerisk.operators import rules
from changerisk.session import checkpoint_dir
from changerisk.sources import records, reports, scripts, snapshots
from changerisk.workload import adapters
from changerisk.workload.adapters import pick, pick_sql, table
from changerisk.workload.registry import query
from changerisk.workload.sqltext import (
    CORPUS,
    RELATION_STATS,
    RULES,
    SERVERS,
    UNITS,
    cte,
    resolved,
)
from changerisk.seeds.tables import TIERS
from changerisk.workload.rollups import _FILE as FILE_VERDICT_SQL
from changerisk.workload.verdicts import OFFLINE, flat, snapshot, written


def folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/changerisk-files-{uuid.uuid4().hex}"


def raw_files(spark, sf) -> DataFrame:
    """Script files from documents: some with a byte order mark, some broken."""
    d, text = F.col("doc_id"), F.col("text").cast("binary")
    content = (F.when(d % 7 == 1, F.concat(F.unhex(F.lit("EFBBBF")), text))
               .when(d % 7 == 2, F.concat(text, F.unhex(F.lit("FF41"))))
               .when(d % 7 == 3, F.concat(text, F.unhex(F.lit("0A0A0041")))).otherwise(text))
    return table(spark, sf, "documents").select(
        F.concat(F.lit("/scripts/"), "source", F.lit("/f"), d.cast("string"), F.lit(".sql")
                 ).alias("path"), content.alias("content"))


@query("script_scan", """
SELECT '/scripts/' || source || '/f' || CAST(doc_id AS VARCHAR) || '.sql' AS path,
  CASE WHEN doc_id % 7 IN (2, 3) THEN '' ELSE text END AS source,
  CASE doc_id % 7 WHEN 2 THEN 'not valid UTF-8' WHEN 3 THEN 'contains a NUL byte' ELSE '' END AS error,
  CASE WHEN doc_id % 7 = 3 THEN length(text) - length(replace(text, chr(10), '')) + 3 ELSE -1 END
    AS error_line FROM documents""")
def script_scan(spark, sf):
    return scripts.decode_scripts(raw_files(spark, sf)).select(
        "path", F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("error", F.lit("")).alias("error"),
        F.coalesce("error_line", F.lit(-1)).alias("error_line"))


@query("manifest_check", """
SELECT 'f' || CAST(doc_id AS VARCHAR) || '.sql' AS file, CASE WHEN doc_id % 5 = 0 THEN 'missing'
  WHEN doc_id % 5 = 1 THEN 'changed' ELSE 'ok' END AS status,
  CASE WHEN doc_id % 5 = 1 THEN sha256('x' || text) ELSE sha256(text) END AS recorded FROM documents""")
def manifest_check(spark, sf):
    d = table(spark, sf, "documents")
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".sql"))
    seen = F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit("x"), "text")).otherwise(F.col("text"))
    manifest = d.select(name.alias("file"), F.sha2(seen.cast("binary"), 256).alias("sha256"),
                        F.octet_length(seen).alias("bytes"))
    files = d.filter("doc_id % 5 <> 0").select(
        F.concat(F.lit("/corpus/"), name).alias("path"), F.col("text").cast("binary").alias(
            "content"))
    return scripts.check_manifest(manifest, files).select(
        "file", "status", F.col("sha256").alias("recorded"))


@query("snapshot_scan", cte(RELATION_STATS) + """
SELECT db_id, relation, CASE WHEN r = 2 AND db_id = 3 THEN -1 ELSE row_count END AS reltuples,
       CASE WHEN r = 5 THEN -1 ELSE mods END AS n_mod FROM relation_stats WHERE db_id <> 4""")
def snapshot_scan(spark, sf):
    """Snapshots written as JSON, one document per database, and read back by schema."""
    path = folder(spark)
    # a snapshot lists the relations one corpus names in one database
    documents = adapters.relations(spark, sf).groupBy("db_id").agg(
        F.collect_list(F.struct(F.col("relation").alias("requested"), "facts")).alias(
            "relations")).select(F.when(F.col("db_id") == 4, 4).otherwise(5).alias(
                "snapshot_format"), "db_id", "relations")
    documents.write.json(path)
    found = records.snapshot_relations(records.read_snapshots(spark, path))
    return found.select(
        "db_id", "relation",
        F.coalesce("facts.reltuples.value", F.lit(-1)).alias("reltuples"),
        F.coalesce("facts.n_mod.value", F.lit(-1)).alias("n_mod"))


@query("snapshot_facts", cte(RELATION_STATS, SERVERS) + """
SELECT 'relations' AS scope, db_id, relation AS object,
       CASE WHEN r = 2 AND db_id = 3 THEN -1 ELSE row_count END AS a,
       CASE WHEN r = 5 THEN -1 ELSE mods END AS b FROM relation_stats
UNION ALL SELECT 'servers', db_id, '', pg_version, coalesce(probe_ms, -1) FROM servers""")
def snapshot_facts(spark, sf):
    """A whole snapshot written as one row per fact and folded back; no list per database."""
    path = folder(spark)
    snapshots.write_snapshot(snapshot(spark, sf), path)
    found = snapshots.read_snapshot(spark, path)
    return found.relations.select(
        F.lit("relations").alias("scope"), "db_id", F.col("relation").alias("object"),
        F.coalesce("facts.reltuples.value", F.lit(-1)).alias("a"),
        F.coalesce("facts.n_mod.value", F.lit(-1)).alias("b")).unionByName(found.servers.select(
            F.lit("servers").alias("scope"), "db_id", F.lit("").alias("object"),
            F.col("pg_version").cast("bigint").alias("a"),
            F.coalesce("probe.value", F.lit(-1)).alias("b")))


@query("rule_table_load", cte(CORPUS, UNITS, RULES, resolved("17")) + """
SELECT is_action, r_rule_ord AS rule_ord, count(*) AS parts FROM resolved
WHERE r_rule_ord IS NOT NULL GROUP BY 1, 2""")
def rule_table_load(spark, sf):
    """The rule dimension from a JSON file, applied to the corpus."""
    path = folder(spark)
    seeds.rules(spark).write.json(path)
    loaded = scripts.read_rules(spark, path)
    units = rules.explode_units(adapters.statements(spark, sf)).withColumn(
        "pg_version", F.lit(17))
    used = rules.apply_rules(units, loaded).filter(F.col("rule").isNotNull())
    return used.groupBy("is_action", F.col("rule.rule_ord").alias("rule_ord")).agg(
        F.count("*").alias("parts"))


TRUTHS = ["safe", "needs_timing", "unsafe"]


@query("result_scan", f"""
SELECT CAST(event_id // 4 AS VARCHAR) AS case_id, event_id AS idx, event_type AS kind,
  {pick_sql(TRUTHS, "event_id % 3")} AS predicted, {pick_sql(TRUTHS, "user_id % 3")} AS truth,
  CAST(floor(value) AS BIGINT) AS hold_ms FROM events WHERE event_id % 8 <> 5""")
def result_scan(spark, sf):
    """Nested result documents, one per case of four statements, exploded."""
    i, none = F.col("event_id"), F.lit(None).cast("string")
    predicted = F.struct(pick(TRUTHS, i % 3).alias("tier"), none.alias("refusal"),
                         none.alias("refused_from"), none.alias("deciding_kind"),
                         none.alias("deciding_constant_key"),
                         F.lit(None).cast("bigint").alias("deciding_high_ms"))
    truth = F.when(i % 8 != 5, F.struct(
        pick(TRUTHS, F.col("user_id") % 3).alias("tier"), F.lit("none").alias("block"),
        F.floor("value").cast("bigint").alias("hold_ms"),
        F.lit(None).cast("double").alias("boundary_proximity")))
    statement = F.struct(i.alias("index"), F.col("event_type").alias("kind"),
                         none.alias("outcome"), predicted.alias("predicted"),
                         truth.alias("truth"))
    path = folder(spark)
    cases = table(spark, sf, "events").groupBy((i / 4).cast("bigint").alias("c")).agg(
        F.collect_list(statement).alias("statements"))
    cases.select(F.array(F.struct(
        F.col("c").cast("string").alias("case"), F.lit("f").alias("family"),
        none.alias("adversarial"), "statements")).alias("results")).write.json(path)
    return records.read_results(spark, path).select("case_id", "idx", "kind", "predicted",
                                                    "truth", "hold_ms")


@query("profile_scan", """
SELECT l_returnflag AS profile, l_linestatus AS family, l_suppkey AS table_no,
       l_linenumber * 300000 AS rows_, CAST(floor(l_extendedprice) AS BIGINT) AS ms
FROM lineitem WHERE l_partkey % 31 <> 0 AND l_linenumber * 300000 >= 1000000""")
def profile_scan(spark, sf):
    """Hardware profiles as JSON documents, one per reading."""
    path = folder(spark)
    record = F.struct(
        F.lit("c").alias("case"), F.col("l_linestatus").alias("family"),
        F.col("l_suppkey").cast("string").alias("table"),
        (F.col("l_linenumber") * 300_000).cast("bigint").alias("rows"),
        F.floor("l_extendedprice").cast("bigint").alias("ms"), F.lit(1).alias("pass_"),
        F.when(F.col("l_partkey") % 31 == 0, "timeout").alias("error"))
    documents = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("profile"), F.array(record).alias("records"))
    documents.write.json(path)
    found = records.profile_readings(spark.read.schema(records.PROFILE_FILE).json(path))
    return found.select("profile", "family", F.col("table").cast("bigint").alias("table_no"),
                        F.col("rows").alias("rows_"), "ms")


@query("verdict_sink", OFFLINE + """
SELECT file_id, idx, kind, tier, coalesce(band, '') AS band, method, 'second' AS run_id
FROM statement_verdicts""")
def verdict_sink(spark, sf):
    """Two runs appended to one partitioned table; reading one prunes the other."""
    path, assessed = folder(spark), written(spark, sf, False).statements
    scripts.write_verdicts(assessed, path, "first")
    scripts.write_verdicts(assessed, path, "second")
    return scripts.read_verdicts(spark, path).filter("run_id = 'second'").withColumn(
        "band", F.coalesce("band", F.lit("")))


_ESCAPED = """
array_to_string(list_transform(string_split(replace(replace(replace(replace(replace(text,
  chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'),
  chr(9), chr(92) || 't'), chr(13), chr(92) || 'r'), ''),
  lambda c: CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) < 65536
    THEN chr(92) || 'u' || format('{:04x}', unicode(c))
    ELSE chr(92) || 'u' || format('{:04x}', 55296 + (unicode(c) - 65536) // 1024)
      || chr(92) || 'u' || format('{:04x}', 56320 + (unicode(c) - 65536) % 1024) END), '')
"""


@query("canonical_documents", f"""
SELECT doc_id, sha256('{{"body":"' || {_ESCAPED} || '","index":' || CAST(doc_id AS VARCHAR)
  || ',"refusal":null}}') AS sha256 FROM documents""")
def canonical_documents(spark, sf):
    document = F.struct(F.col("text").alias("body"), F.col("doc_id").alias("index"),
                        F.lit(None).cast("string").alias("refusal"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(
        reports.canonical_json(document), 256).alias("sha256"))


_PARTS = """
WITH d AS (SELECT CAST(user_id AS VARCHAR) AS file_id, event_id AS idx,
             '{"event":' || CAST(event_id AS VARCHAR) || ',"type":"' || event_type || '"}' AS doc
           FROM events),
p AS (SELECT file_id, idx // 1000 AS part, count(*) AS statements,
        '[' || string_agg(doc, ',' ORDER BY idx) || ']' AS body FROM d GROUP BY 1, 2)
"""


def event_documents(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("file_id"),
                    F.col("event_id").alias("idx"), reports.canonical_json(F.struct(
                        F.col("event_id").alias("event"), F.col("event_type").alias("type"))
                    ).alias("document"))


@query("report_parts", _PARTS + """
SELECT file_id, part, statements, sha256(body) AS sha256 FROM p""")
def report_parts(spark, sf):
    return reports.report_parts(event_documents(spark, sf)).drop("body")


@query("report_hashes", _PARTS + """
, l1 AS (SELECT file_id, part // 1000 AS part, sha256(string_agg(sha256(body), '' ORDER BY part)) AS h
         FROM p GROUP BY 1, 2),
l2 AS (SELECT file_id, part // 1000 AS part, sha256(string_agg(h, '' ORDER BY part)) AS h
       FROM l1 GROUP BY 1, 2)
SELECT file_id, sha256(sha256(string_agg(h, '' ORDER BY part))) AS report_sha256
FROM l2 GROUP BY file_id""")
def report_hashes(spark, sf):
    return reports.report_hashes(reports.report_parts(event_documents(spark, sf)))


@query("statement_reports", None)
def statement_reports(spark, sf):
    """Report parts of the assessed corpus."""
    parts = reports.report_parts(reports.statement_documents(written(spark, sf, True).statements))
    return parts.drop("body")


def _json(**fields: str) -> str:
    """SQL for a canonical object of ready JSON texts."""
    inside = " || ',' || ".join(f"'\"{n}\":' || {fields[n]}" for n in sorted(fields))
    return f"'{{' || {inside} || '}}'"


def _js(column: str) -> str:
    return f"coalesce('\"' || {column} || '\"', 'null')"


def _num(column: str) -> str:
    return f"coalesce(CAST({column} AS VARCHAR), 'null')"


_COUNTED = "'{' || " + " || ',' || ".join(
    f"'\"{t}\":' || CAST(count(*) FILTER (WHERE tier = '{t}') AS VARCHAR)"
    for t in sorted(TIERS)) + " || '}'"


@query("report_roots", OFFLINE + f"""
, entries AS (
  SELECT file_id, 'head' AS section, CAST(0 AS BIGINT) AS idx, {_json(
    classification_counts=_COUNTED, online="'false'", statements="CAST(count(*) AS VARCHAR)",
    verdict=_js(FILE_VERDICT_SQL))} AS doc FROM statement_verdicts GROUP BY file_id
  UNION ALL SELECT file_id, 'statements', idx, {_json(
    band=_js("band"), classification=_js("tier"), index=_num("idx"), kind=_js("kind"),
    line=_num("line"), method=_js("method"), refusal=_js("refusal"),
    refused_from=_js("refused_from"), reversibility=_js("reversibility"),
    statement_lock_level=_num("lock_level"))} FROM statement_verdicts
  UNION ALL SELECT file_id, 'irreversible', idx, {_json(
    index=_num("idx"), kind=_js("kind"), line=_num("line"))} FROM statement_verdicts
    WHERE reversibility = 'irreversible'
  UNION ALL SELECT file_id, 'rollback', idx, {_json(
    index=_num("idx"), line=_num("line"),
    role="CASE WHEN reversibility = 'irreversible' THEN '\"blocker\"' ELSE '\"undecided\"' END")}
    FROM statement_verdicts WHERE reversibility <> 'reversible'
  UNION ALL SELECT file_id, 'rules', idx, {_json(
    action=_num("action_pos"), conditional=_num("conditional"), in_do_block=_num("in_block"),
    index=_num("idx"), inner=_num("inner_pos"), kind=_js("ukind"), rule=_num("r_rule_ord"))}
    FROM parts WHERE r_kind IS NOT NULL
  UNION ALL SELECT file_id, 'evidence', 0, {_json(
    bytes="CAST(strlen(t) AS VARCHAR)", name="'\"change.sql\"'", sha256=_js("sha256(t)"))}
    FROM (SELECT file_id, 'file ' || file_id AS t FROM (SELECT DISTINCT file_id FROM stmts))),
p AS (SELECT file_id, section, idx // 1000 AS part, count(*) AS entries,
        sha256('[' || string_agg(doc, ',' ORDER BY idx, doc) || ']') AS h FROM entries GROUP BY 1, 2, 3),
l1 AS (SELECT file_id, section, part // 1000 AS part, sum(entries) AS entries,
         sha256(string_agg(h, '' ORDER BY part)) AS h FROM p GROUP BY 1, 2, 3),
roots AS (SELECT file_id, section, sum(entries) AS entries,
            sha256(sha256(sha256(string_agg(h, '' ORDER BY part)))) AS h FROM l1 GROUP BY 1, 2)
SELECT file_id, section, CAST(entries AS BIGINT) AS entries, h AS report_sha256 FROM roots
UNION ALL SELECT file_id, '', CAST(sum(entries) AS BIGINT),
  sha256(string_agg(section || ':' || h, chr(10) ORDER BY section || ':' || h)) FROM roots GROUP BY 1""")
def report_roots(spark, sf):
    """The assessed corpus as reports in coded form: a section merge under a hash tree."""
    assessed = written(spark, sf, False)
    files = assessed.statements.select("file_id").distinct()
    entries = reports.report_entries(
        assessed.parts, flat(assessed), online=False, prose=False,
        sources=files.withColumn("source", F.concat(F.lit("file "), "file_id")))
    # Locks and open points have queries of their own; their wording is not SQL's.
    kept = entries.where(~F.col("section").isin("locks", "unverified"))
    return reports.report_roots(reports.section_parts(kept))


@query("change_ids", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'change-' || CAST(doc_id AS VARCHAR)
                    ELSE sha256(text) END AS change_id FROM documents""")
def change_ids(spark, sf):
    d = table(spark, sf, "documents")
    given = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("change-"),
                                                      F.col("doc_id").cast("string")))
    return reports.change_ids(d.select(F.col("doc_id").alias("file_id"), given.alias("change_id"),
                                       F.col("text").alias("source"))).withColumnRenamed(
        "file_id", "doc_id")


EVIDENCE = ["snapshot.json", "rules.json", "../escape", "constants.json"]


def _evidence(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents")
    key = F.col("doc_id")
    name, report = pick(EVIDENCE, key % 4), (key / 4).cast("bigint").alias("report_id")
    changed = F.when(key % 10 == 7, F.lit("tampered")).otherwise(F.col("text"))
    recorded = d.select(report, name.alias("name"), F.sha2(changed.cast("binary"), 256).alias(
        "sha256"))
    files = d.filter("doc_id % 10 <> 3").select(report, name.alias("name"),
                                                F.col("text").cast("binary").alias("content"))
    return recorded, files


_EVIDENCE = f"""
WITH e AS (SELECT doc_id // 4 AS report_id, {pick_sql(EVIDENCE, "doc_id % 4")} AS name,
  CASE WHEN doc_id % 4 = 2 THEN 'BAD NAME' WHEN doc_id % 10 = 3 THEN 'MISSING'
       WHEN doc_id % 10 = 7 THEN 'MISMATCH' ELSE 'ok' END AS status, doc_id,
  CASE WHEN doc_id % 10 = 7 THEN sha256('tampered') ELSE sha256(text) END AS h FROM documents)
"""


@query("evidence_check", _EVIDENCE + "SELECT report_id, name, status FROM e")
def evidence_check(spark, sf):
    recorded, files = _evidence(spark, sf)
    return reports.check_evidence(recorded, files).select("report_id", "name", "status")


@query("evidence_verdicts", _EVIDENCE + """
SELECT report_id, bool_and(status = 'ok') AS files_ok, report_id % 3 <> 1 AS snapshot_ok,
       bool_and(status = 'ok') AND report_id % 3 <> 1 AS ok FROM e GROUP BY report_id""")
def evidence_verdicts(spark, sf):
    recorded, files = _evidence(spark, sf)
    report = F.col("report_id")
    headline = recorded.filter("name = 'snapshot.json'").select(
        report, F.when(report % 3 == 0, F.col("sha256")).when(report % 3 == 1, F.lit("other"))
        .alias("snapshot_hash"))
    return reports.evidence_verdicts(reports.check_evidence(recorded, files), headline)

