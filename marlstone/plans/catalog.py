"""All queries of the library itself."""

from __future__ import annotations

from marlstone.plans import context_queries, evaluation_queries, reasoning_queries, registry, space_queries, spec_queries, store_queries

MODULES = (store_queries, context_queries, reasoning_queries, space_queries, evaluation_queries, spec_queries)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
