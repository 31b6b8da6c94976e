"""Rollups of statement verdicts to files, runs and ledgers.

``statements`` here is the output of the assessment plan or any table with
``file_id, idx, line, kind, tier, method, undo`` columns. Lists that could
grow with a file are returned as rows, not collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changerisk.functions import tiers
from changerisk.seeds import tables


def tier_counts(statements: DataFrame, keys: list[str]) -> DataFrame:
    """Count per tier, zero-filled for all five."""
    return statements.groupBy(*keys).agg(*[
        F.count_if(F.col("tier") == tier).alias(tier) for tier in tables.TIERS])


def file_verdicts(files: DataFrame, statements: DataFrame) -> DataFrame:
    """Verdict of each file from its worst statement; an empty file proceeds."""
    worst = statements.groupBy("file_id").agg(
        F.max(tiers.tier_rank(F.col("tier"))).alias("worst"))
    return files.join(worst, "file_id", "left").withColumn(
        "verdict", tiers.file_verdict(F.col("worst"))).drop("worst")


def effective_verdict(status: Column, verdict: Column) -> Column:
    """A file nobody assessed counts as needing approval."""
    return F.when((status == "assessed") & verdict.isNotNull(), verdict).otherwise(
        "requires_approval")


def run_verdicts(files: DataFrame) -> DataFrame:
    """Verdict of each run: its worst file; a run without files proceeds."""
    rank = tiers.verdict_rank(effective_verdict(F.col("status"), F.col("verdict")))
    return files.groupBy("run_id").agg(F.max(rank).alias("worst")).select(
        "run_id", F.coalesce(tiers.verdict_of_rank(F.col("worst")), F.lit("proceed")
                             ).alias("verdict"))


def run_summary(files: DataFrame) -> DataFrame:
    """Detected, assessed, unsupported and failed files with tier totals.

    ``files`` holds one row per file with its tier counts. Rows with a NULL
    ``file_id`` are the totals of their run.
    """
    assessed = F.col("status") == "assessed"
    return files.rollup("run_id", "file_id").agg(
        F.count("*").alias("detected"), F.count_if(assessed).alias("assessed"),
        F.count_if(F.col("status") == "unsupported").alias("unsupported"),
        F.count_if(F.col("status") == "error").alias("errors"),
        *[F.coalesce(F.sum(F.when(assessed, F.col(t))), F.lit(0)).alias(t)
          for t in tables.TIERS],
    ).filter(F.col("run_id").isNotNull())


def irreversible_ledger(statements: DataFrame) -> DataFrame:
    """One row per statement without an undo, with what it loses."""
    return statements.filter(F.col("reversibility") == "irreversible").select(
        "file_id", "idx", "line", "kind",
        F.coalesce("lost", F.lit("state is lost")).alias("lost"))


def rollback_feasibility(statements: DataFrame) -> DataFrame:
    """Can a file be rolled back: no, unknown or yes, with the counts behind it."""
    state = F.col("reversibility")
    out = statements.groupBy("file_id").agg(
        F.count_if(state == "irreversible").alias("blockers"),
        F.count_if(state == "unknown").alias("undecided"))
    return out.withColumn("feasible", F.when(F.col("blockers") > 0, "no")
                          .when(F.col("undecided") > 0, "unknown").otherwise("yes"))


def rollback_reasons(statements: DataFrame) -> DataFrame:
    """The statements behind a rollback answer other than yes."""
    state = F.col("reversibility")
    return statements.filter(state != "reversible").select(
        "file_id", "idx", "line", F.when(state == "irreversible", "blocker")
        .otherwise("undecided").alias("role"),
        F.coalesce("lost", F.lit("reversibility is not known")).alias("reason"))


def unverified_ledger(parts: DataFrame, statements: DataFrame, online: bool) -> DataFrame:
    """Everything that was not checked, and why.

    File-level entries come with ``idx`` NULL; each constant an estimate used
    is listed once per file.
    """
    none = F.lit(None).cast("bigint")
    files = statements.select("file_id").distinct()

    def file_level(source: str, reason: str) -> DataFrame:
        return files.select("file_id", none.alias("idx"), F.lit(source).alias("source"),
                            F.lit(reason).alias("reason"))

    head = file_level(*(("snapshot_limits", "facts describe the time of capture")
                        if online else ("no_snapshot", "sizes, locks and schema were not read")))
    queue = file_level("execution_state", "the lock queue at execution time is not known")
    unknown = statements.filter(F.col("tier") == "unknown").select(
        "file_id", "idx", F.lit("unknown_classification").alias("source"),
        F.col("rationale").alias("reason"))
    refused = parts.filter(F.col("duration.refusal").isNotNull()).select(
        "file_id", "idx", F.lit("cannot_estimate").alias("source"),
        F.col("duration.refusal").alias("reason"))
    constants = parts.filter(F.col("duration.constant_key").isNotNull()).select(
        "file_id", none.alias("idx"), F.lit("uncalibrated_constant").alias("source"),
        F.col("duration.constant_key").alias("reason")).distinct()
    return (head.unionByName(queue).unionByName(unknown).unionByName(refused)
            .unionByName(constants))


def rules_used(parts: DataFrame) -> DataFrame:
    """Which rule row each statement part was resolved to."""
    return parts.filter(F.col("rule").isNotNull()).select(
        "file_id", "idx", "inner_pos", "action_pos", "kind", "is_action", "in_block",
        "conditional", F.col("rule.rule_ord").alias("rule_ord"),
        F.size("rule.affected").alias("roles"), F.size("locks").alias("relations"))


def distribution(statements: DataFrame, column: str) -> DataFrame:
    """Count and share (per mille, floored) of each value of a column."""
    counts = statements.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.select(F.lit(column).alias("dimension"), "value", "n",
                         F.expr("(1000 * n) div sum(n) OVER (PARTITION BY 1)").alias("per_mille"))


def top_kinds(statements: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most frequent kinds of each tier."""
    counts = statements.groupBy("tier", "kind").agg(F.count("*").alias("n"))
    order = W.partitionBy("tier").orderBy(F.desc("n"), "kind")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def exemplars(units: DataFrame, k: int = 6) -> DataFrame:
    """The first ``k`` statements of each kind in file order.

    Spark prunes to ``k`` rows per kind in every task before the shuffle.
    """
    order = W.partitionBy("kind").orderBy("file_id", "idx")
    return units.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def unknown_buckets(statements: DataFrame, keys: list[str]) -> DataFrame:
    """Undecided statements counted by the reason bucket and further keys."""
    from changerisk.functions.text import rationale_bucket

    return (statements.filter(F.col("tier") == "unknown")
            .withColumn("bucket", rationale_bucket(F.col("rationale")))
            .groupBy("bucket", *keys).agg(F.count("*").alias("n")))


def unknown_samples(statements: DataFrame, k: int = 12) -> DataFrame:
    """Up to ``k`` undecided statements per reason bucket, in file order."""
    from changerisk.functions.text import rationale_bucket

    order = W.partitionBy("bucket").orderBy("file_id", "idx")
    return (statements.filter(F.col("tier") == "unknown")
            .withColumn("bucket", rationale_bucket(F.col("rationale")))
            .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k))


def unknown_transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Where undecided statements went once the statistics were fresh."""
    from changerisk.functions.text import rationale_bucket

    old = before.filter(F.col("tier") == "unknown").select(
        "file_id", "idx", rationale_bucket(F.col("rationale")).alias("bucket"))
    new = after.select("file_id", "idx", F.col("tier").alias("new_tier"))
    return (old.join(new, ["file_id", "idx"], "left").groupBy("bucket", "new_tier")
            .agg(F.count("*").alias("n")))
