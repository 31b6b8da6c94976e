"""Operators for building large text corpora, and their registered queries."""

from changerisk.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
