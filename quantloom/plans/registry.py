"""All queries over the given tables, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.sources.fixtures import with_fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its SQL may use the derived tables of sources.fixtures by name."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_fixtures(sql)
        return f

    return add


from quantloom.plans import (  # noqa: E402, F401  each registers its queries
    closure,
    documents,
    estimate,
    incremental,
    matching,
    pricing,
    reports,
)
