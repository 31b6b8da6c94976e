"""The assessment of the event-log corpus, offline and with catalog facts."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changerisk.operators.verdict import Snapshot
from changerisk.plans.assess import Assessment, assess
from changerisk.session import cut_lineage
from changerisk.workload import adapters
from changerisk.workload.registry import query
from changerisk.workload.verdictsql import assessment

OFFLINE, ONLINE = assessment(False), assessment(True)


def snapshot(spark, sf) -> Snapshot:
    return Snapshot(adapters.servers(spark, sf), adapters.relations(spark, sf),
                    adapters.types(spark, sf), adapters.type_changes(spark, sf),
                    waiters=adapters.waiters(spark, sf))


def online(spark, sf) -> Assessment:
    return assess(adapters.statements(spark, sf), snapshot(spark, sf))


def offline(spark, sf) -> Assessment:
    return assess(adapters.statements(spark, sf), pg_version=17)


def flat(assessed: Assessment | Written) -> DataFrame:
    v = F.col("verdict")
    return assessed.statements.select(
        "file_id", "idx", "line", F.col("statement_kind").alias("kind"), "deciding_kind",
        v["tier"].alias("tier"), v["method"].alias("method"), v["band"].alias("band"),
        v["rationale"].alias("rationale"), v["refusal"].alias("refusal"),
        v["refused_from"].alias("refused_from"),
        F.col("undo.reversibility").alias("reversibility"), F.col("undo.lost").alias("lost"),
        "lock_level")


class Written:
    """An assessment whose tables are written when a query first reads them."""

    def __init__(self, assessed: Assessment) -> None:
        self._assessed = assessed

    @cached_property
    def parts(self) -> DataFrame:
        return cut_lineage(self._assessed.parts.select(*_PART_COLUMNS))

    @cached_property
    def statements(self) -> DataFrame:
        return cut_lineage(self._assessed.statements)


_WRITTEN: dict[tuple[str, str, bool], Written] = {}
_PART_COLUMNS = ["file_id", "idx", "inner_pos", "action_pos", "db_id", "kind", "is_action",
                 "statement_kind", "in_block", "conditional", "branch", "block", "file_local",
                 "live_exclusive", "contended", "contention_active", "rule", "locks",
                 "all_locks", "duration", "verdict", "empty"]


def written(spark, sf, with_facts: bool) -> Written:
    """The assessment as tables, each written once per session and read by every rollup."""
    key = (spark.sparkContext.applicationId, sf, with_facts)
    if key not in _WRITTEN:
        _WRITTEN[key] = Written(online(spark, sf) if with_facts else offline(spark, sf))
    return _WRITTEN[key]


_STATEMENT = ("SELECT file_id, idx, kind, deciding_kind, tier, method, band, refusal, "
              "refused_from, reversibility, lock_level FROM statement_verdicts")
_SHOWN = ["file_id", "idx", "kind", "deciding_kind", "tier", "method", "band", "refusal",
          "refused_from", "reversibility", "lock_level"]


@query("assess_offline", OFFLINE + _STATEMENT)
def assess_offline(spark, sf):
    return flat(offline(spark, sf)).select(*_SHOWN)


@query("assess_online", ONLINE + _STATEMENT)
def assess_online(spark, sf):
    return flat(online(spark, sf)).select(*_SHOWN)


@query("part_verdicts", ONLINE + """
SELECT file_id, idx, inner_pos, action_pos, ukind AS kind, branch, block, file_local, live_ax,
       contended, active, coalesce(point, -1) AS point_ms, coalesce(high, -1) AS high_ms, tier,
       method, band FROM parts WHERE branch <> 'matched_dml'
UNION ALL
SELECT file_id, idx, inner_pos, action_pos, ukind, branch, block, file_local, live_ax, contended,
       active, -1, -1, tier, method, band FROM parts WHERE branch = 'matched_dml'""")
def part_verdicts(spark, sf):
    v, d = F.col("verdict"), F.col("duration")
    return online(spark, sf).parts.select(
        "file_id", "idx", "inner_pos", "action_pos", "kind", "branch", "block", "file_local",
        F.col("live_exclusive").alias("live_ax"), "contended",
        F.col("contention_active").alias("active"),
        F.coalesce(d["point_ms"], F.lit(-1)).alias("point_ms"),
        F.coalesce(d["high_ms"], F.lit(-1)).alias("high_ms"), v["tier"].alias("tier"),
        v["method"].alias("method"), v["band"].alias("band"))
