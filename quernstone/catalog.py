"""All queries of the library itself, and their SQL."""

from __future__ import annotations

from .plans import aggregates, analytics, keyed, read_api, relations, shapes, streams
from .plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "aggregates", "analytics", "keyed", "read_api", "relations", "shapes", "streams"]
