"""Queries over the given tables that exercise every operator."""

from changerisk.workload import (  # noqa: F401
    evaluation,
    measurement,
    narrowing,
    ordering,
    preflight,
    resolution,
    rollups,
    rules_of_verdicts,
    sizing,
    snapshots,
    storage,
    streams,
    texts,
    verdicts,
)
from changerisk.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
