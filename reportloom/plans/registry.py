"""Where queries and their SQL are put down."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, **ctes: str) -> Callable[[Query], Query]:
    """Registers a query by its name, with the SQL of the same result over the named subqueries."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = (f"WITH {', '.join(f'{k} AS ({v})' for k, v in ctes.items())} " if ctes else "") + sql
        return f

    return put
