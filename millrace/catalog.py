"""All queries of the library, with SQL for another engine where it can express them."""

from __future__ import annotations

from .plans import extension_queries, fact_queries, function_queries, link_queries, plugin_queries, registry, scan_queries, type_queries  # noqa: F401  each registers its queries


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
