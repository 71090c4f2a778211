"""Name → query function and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``."""

    def add(function: Query) -> Query:
        if name in _queries:
            raise KeyError(f"query {name} is registered twice")
        _queries[name] = function
        if sql is not None:
            _sql[name] = sql
        return function

    return add


def all_queries() -> dict[str, Query]:
    return dict(_queries)


def all_sql() -> dict[str, str]:
    return dict(_sql)
