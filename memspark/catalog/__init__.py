"""Registered queries and their oracle SQL."""

from memspark.catalog import pairs_and_patterns, similarity_and_search, streams, tables_and_filters, text_and_stats

_MODULES = [tables_and_filters, text_and_stats, pairs_and_patterns, similarity_and_search, streams]


def all_queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.Q.items()}


def all_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
