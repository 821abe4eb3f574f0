"""All queries on images, points and strings, with their SQL twins."""

from __future__ import annotations

from chordgrid.plans import loader_queries, point_queries, string_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for module in (point_queries, string_queries, loader_queries):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
