"""All queries of the read operators and the SQL that gives the same rows."""

from __future__ import annotations

from readloom.plans import row_queries, set_queries  # noqa: F401  (they register their queries)
from readloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
