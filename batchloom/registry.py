"""Registered queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

from batchloom.plans.base import ORACLES, QUERIES
from batchloom.plans import queries_audit, queries_more, queries_reads, queries_rules, queries_sources, queries_streams, queries_text, queries_upkeep  # noqa: F401  (they register themselves)

__all__ = ["ORACLES", "QUERIES"]
