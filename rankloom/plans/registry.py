"""All queries of the core library, by name, with their DuckDB oracles."""

from __future__ import annotations

from rankloom.plans import analytics_queries, deep_queries, more_queries, run_queries, retrieval_queries, scoring_queries  # noqa: F401
from rankloom.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
