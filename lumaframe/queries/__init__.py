"""Registered queries: each applies an operator to the driver's tables and states its result in SQL as well."""

from __future__ import annotations

from lumaframe.queries import detectors, library, rules, statistics
from lumaframe.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "detectors", "library", "rules", "statistics"]
