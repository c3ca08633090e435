"""Queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from oddslake.plans import (
    audit_queries,
    book_queries,
    discover_queries,
    history_queries,
    normalize_queries,
    scalar_queries,
    snapshot_queries,
    storage_queries,
    stream_queries,
    topic_queries,
)
from oddslake.plans.registry import Query

QUERIES: list[Query] = [
    *snapshot_queries.QUERIES,
    *normalize_queries.QUERIES,
    *book_queries.QUERIES,
    *topic_queries.QUERIES,
    *history_queries.QUERIES,
    *discover_queries.QUERIES,
    *audit_queries.QUERIES,
    *stream_queries.QUERIES,
    *scalar_queries.QUERIES,
    *storage_queries.QUERIES,
]
