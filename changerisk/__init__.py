"""Database change risk at fleet scale, as Spark DataFrame operations."""

from changerisk.functions.durations import RateTable
from changerisk.operators.verdict import Snapshot
from changerisk.plans.assess import Assessment, assess
from changerisk.streaming.jobs import assess_stream, tag_scripts

__all__ = ["Assessment", "RateTable", "Snapshot", "assess", "assess_stream", "tag_scripts"]
