"""Reports as canonical JSON, and checks of stored evidence.

A file may hold any number of statements, so its report is a sequence of parts
of bounded size. Each part has its hash, and the file's hash is the root of a
tree over the part hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changerisk.functions import tiers
from changerisk.functions.durations import int_div
from changerisk.operators import rollup
from changerisk.seeds.tables import TIERS

PART_STATEMENTS = 1000
_TREE_LEVELS = 4
#: Different characters outside ASCII that are replaced one after the other; a
#: text with more is cut into pieces.
_FEW = 64


def escape_non_ascii(text: Column) -> Column:
    """Characters outside ASCII as ``\\uXXXX``, beyond the basic plane as a pair."""
    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code.cast("bigint")), 4, "0")))

    def one(ch: Column) -> Column:
        code = F.ascii(ch)
        rest = code - 0x10000
        return (F.when(code < 0x80, ch).when(code < 0x10000, unit(code))
                .otherwise(F.concat(unit(int_div(rest, 1024) + 0xD800),
                                    unit(rest.bitwiseAND(0x3FF) + 0xDC00))))

    def escaped(seen: Column) -> Column:
        # Pieces are single characters outside ASCII and the runs between them,
        # which stay as they are; never cut inside a pair.
        pieces = F.split(
            text, r"(?<=[^\x00-\x7F])(?![\uDC00-\uDFFF])|(?=[^\x00-\x7F\uDC00-\uDFFF])")
        return F.when(F.size(seen) <= _FEW, F.aggregate(
            seen, text, lambda out, ch: F.replace(out, ch, one(ch)))).otherwise(
            F.array_join(F.transform(pieces, one), ""))

    # One lambda over a one-element array keeps the list from being computed per use.
    found = F.array(F.array_distinct(F.regexp_extract_all(
        text, F.lit(r"[^\x00-\x7F]"), F.lit(0))))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.element_at(
        F.transform(found, escaped), 1)).otherwise(text)


def canonical_json(value: Column) -> Column:
    """Compact ASCII JSON; NULL fields stay. Name the struct's fields in sorted order."""
    text = F.to_json(value, {"ignoreNullFields": "false"})
    # control characters in lower-case hex, where there may be any
    lower = text
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        lower = F.regexp_replace(lower, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
    text = F.when(text.contains("\\u00") & text.rlike(r"\\u00(?:0[BEF]|1[A-F])"), lower).otherwise(text)
    return escape_non_ascii(text)


def statement_documents(statements: DataFrame) -> DataFrame:
    """One canonical document per assessed statement."""
    v, undo = F.col("verdict"), F.col("undo")
    document = F.struct(
        v["band"].alias("band"), v["tier"].alias("classification"),
        v["conditions"].alias("conditions"), F.col("idx").alias("index"),
        F.col("statement_kind").alias("kind"), F.col("line"), v["method"].alias("method"),
        v["rationale"].alias("rationale"), v["refusal"].alias("refusal"),
        v["refused_from"].alias("refused_from"),
        F.struct(undo["reversibility"].alias("reversibility"),
                 undo["lost"].alias("what_is_lost")).alias("reversibility"),
        F.col("lock_level").alias("statement_lock_level"))
    return statements.select("file_id", "idx", canonical_json(document).alias("document"))


def report_parts(documents: DataFrame, part_size: int = PART_STATEMENTS) -> DataFrame:
    """Report parts of at most ``part_size`` statement positions with their hash."""
    part = int_div(F.col("idx"), part_size)
    listed = documents.groupBy("file_id", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "document"))).alias("d"),
        F.count("*").alias("statements"))
    body = F.concat(F.lit("["), F.array_join(F.col("d.document"), ","), F.lit("]"))
    return listed.select("file_id", "part", "statements", body.alias("body")).withColumn(
        "sha256", F.sha2("body", 256))


def report_hashes(parts: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Root hash of every report: a tree of four levels with 1000 children per node.

    Four levels hold 1000 ** 4 parts, of 1000 statement positions each.
    """
    level = parts.select(*keys, "part", "sha256")
    for _ in range(_TREE_LEVELS):
        grouped = level.groupBy(*keys, int_div(F.col("part"), 1000).alias("p")).agg(
            F.array_sort(F.collect_list(F.struct("part", "sha256"))).alias("h"))
        level = grouped.select(*keys, F.col("p").alias("part"),
                               F.sha2(F.array_join(F.col("h.sha256"), ""), 256).alias("sha256"))
    return level.select(*keys, F.col("sha256").alias("report_sha256"))


# --- the whole report of a file -------------------------------------------------------
def _entry(df: DataFrame, section: str, idx: Column, **fields: Column) -> DataFrame:
    """Entries of one section; ``idx`` is the statement that one belongs to, 0 for the file."""
    document = F.struct(*[fields[n].alias(n) for n in sorted(fields)])
    return df.select("file_id", F.lit(section).alias("section"), idx.cast("bigint").alias("idx"),
                     canonical_json(document).alias("document"))


def report_entries(parts: DataFrame, statements: DataFrame, *, online: bool,
                   sources: DataFrame | None = None, prose: bool = True) -> DataFrame:
    """All entries of the files' reports: ``(file_id, section, idx, document)``.

    ``parts`` and ``statements`` are those of an assessment, ``statements`` with
    the columns of ``rollup``; ``sources(file_id, source)`` adds the evidence of
    each script. Sections: ``head`` (verdict and counts), ``statements``,
    ``irreversible``, ``rollback``, ``unverified``, ``locks``, ``rules`` and
    ``evidence``. ``prose=False`` leaves out free text, so that equal verdicts
    have equal reports whatever their wording. A file without statements has
    no entry but its evidence.
    """
    col = F.col
    said = lambda **fields: fields if prose else {}
    by_file = rollup.tier_counts(statements, ["file_id"]).join(
        statements.groupBy("file_id").agg(
            F.count("*").alias("n"), F.max(tiers.tier_rank(col("tier"))).alias("worst")), "file_id")
    counts = F.struct(*[col(t).alias(t) for t in sorted(TIERS)])
    sections = [
        _entry(by_file, "head", F.lit(0), classification_counts=counts, online=F.lit(online),
               statements=col("n"), verdict=tiers.file_verdict(col("worst"))),
        _entry(statements, "statements", col("idx"), band=col("band"), classification=col("tier"),
               index=col("idx"), kind=col("kind"), line=col("line"), method=col("method"),
               refusal=col("refusal"), refused_from=col("refused_from"),
               reversibility=col("reversibility"), statement_lock_level=col("lock_level"),
               **said(rationale=col("rationale"), what_is_lost=col("lost"))),
        _entry(rollup.irreversible_ledger(statements), "irreversible", col("idx"),
               index=col("idx"), kind=col("kind"), line=col("line"),
               **said(what_is_lost=col("lost"))),
        _entry(rollup.rollback_reasons(statements), "rollback", col("idx"), index=col("idx"),
               line=col("line"), role=col("role"), **said(reason=col("reason"))),
        _entry(rollup.unverified_ledger(parts, statements, online), "unverified",
               F.coalesce("idx", F.lit(0)), index=col("idx"), source=col("source"),
               **said(reason=col("reason"))),
        _entry(parts.select("file_id", "idx", "inner_pos", "action_pos",
                            F.explode("all_locks").alias("lock")), "locks", col("idx"),
               action=col("action_pos"), certain=col("lock.certain"), index=col("idx"),
               inner=col("inner_pos"), level=col("lock.level"), relation=col("lock.relation")),
        _entry(rollup.rules_used(parts), "rules", col("idx"), action=col("action_pos"),
               conditional=col("conditional"), in_do_block=col("in_block"), index=col("idx"),
               inner=col("inner_pos"), kind=col("kind"), rule=col("rule_ord")),
    ]
    if sources is not None:
        raw = col("source").cast("binary")
        sections.append(_entry(sources, "evidence", F.lit(0), bytes=F.octet_length("source"),
                               name=F.lit("change.sql"), sha256=F.sha2(raw, 256)))
    out, *rest = sections
    for df in rest:
        out = out.unionByName(df)
    return out


def section_parts(entries: DataFrame, part_size: int = PART_STATEMENTS) -> DataFrame:
    """Bounded parts of every section: the entries of at most ``part_size`` statement positions.

    A statement has few entries in a section, so a part's size is bounded by its
    positions however long a file is. Entries stand by statement, then by text.
    """
    listed = entries.groupBy("file_id", "section", int_div(F.col("idx"), part_size).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "document"))).alias("d"),
        F.count("*").alias("entries"))
    body = F.concat(F.lit("["), F.array_join(F.col("d.document"), ","), F.lit("]"))
    return listed.select("file_id", "section", "part", "entries", body.alias("body")).withColumn(
        "sha256", F.sha2("body", 256))


def report_roots(parts: DataFrame) -> DataFrame:
    """Per file and section the number of entries and the root hash; section '' is the whole file.

    The file's hash is that of its ``section:hash`` lines in order of their names.
    """
    keys = ("file_id", "section")
    counts = parts.groupBy(*keys).agg(F.sum("entries").alias("entries"))
    sections = report_hashes(parts, keys).join(counts, list(keys))
    line = F.concat_ws(":", "section", "report_sha256")
    files = sections.groupBy("file_id").agg(
        F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"),
        F.sum("entries").alias("entries"))
    return sections.select(*keys, "entries", "report_sha256").unionByName(files.select(
        "file_id", F.lit("").alias("section"), "entries",
        F.sha2("lines", 256).alias("report_sha256")))


def change_ids(scripts: DataFrame) -> DataFrame:
    """The change id of a file defaults to the hash of its source."""
    return scripts.select("file_id", F.coalesce("change_id", F.sha2("source", 256)
                                                ).alias("change_id"))


def write_report(parts: DataFrame, path: str) -> None:
    parts.write.mode("overwrite").parquet(path)


def check_evidence(recorded: DataFrame, files: DataFrame) -> DataFrame:
    """Status of every recorded evidence file: ok, MISSING, MISMATCH or BAD NAME.

    ``recorded(report_id, name, sha256)``, ``files(report_id, name, content)``.
    """
    actual = files.select("report_id", "name", F.sha2("content", 256).alias("actual"))
    joined = recorded.join(actual, ["report_id", "name"], "left")
    plain = F.col("name").rlike(r"^[^/\\]+$") & ~F.col("name").isin(".", "..")
    return joined.withColumn("status", F.when(~plain, "BAD NAME").when(
        F.col("actual").isNull(), "MISSING").when(F.col("actual") == F.col("sha256"), "ok")
        .otherwise("MISMATCH"))


def evidence_verdicts(checked: DataFrame, reports: DataFrame) -> DataFrame:
    """Per report: every file is ok and the snapshot hash agrees with its entry."""
    folded = checked.groupBy("report_id").agg(
        F.bool_and(F.col("status") == "ok").alias("files_ok"),
        F.max(F.when(F.col("name") == "snapshot.json", F.col("sha256"))).alias("recorded"))
    joined = reports.join(folded, "report_id", "left")
    agrees = F.col("snapshot_hash").isNull() | F.coalesce(
        F.col("recorded") == F.col("snapshot_hash"), F.lit(False))
    return joined.select("report_id", F.coalesce("files_ok", F.lit(False)).alias("files_ok"),
                         agrees.alias("snapshot_ok"),
                         (F.coalesce("files_ok", F.lit(False)) & agrees).alias("ok"))
