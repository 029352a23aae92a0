"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from . import dealt, kb_queries, source_queries, text_queries

_PARTS = (dealt, kb_queries, text_queries, source_queries)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.oracle_sql().items()}
