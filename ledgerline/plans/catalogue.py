"""All queries of the core and their SQL."""

from __future__ import annotations

from ledgerline.plans import dealt, directory_queries, feed_queries, news_queries, register_queries, view_queries

MODULES = [dealt, register_queries, directory_queries, view_queries, feed_queries, news_queries]
FLAGSHIP = directory_queries.facets_self_excluding


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
