"""The core's registered queries and their SQL: QUERIES and SQL are filled by the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def collect() -> tuple[dict[str, Query], dict[str, str]]:
    """All core queries and the SQL of those that SQL can express."""
    from factweave.queries import facts, graphs, lookups, rules, tree, wide

    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for module in (wide, facts, graphs, rules, tree, lookups):
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
