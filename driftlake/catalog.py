"""Registered queries of the engine, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        if f.__name__ in _QUERIES:
            raise ValueError(f"the query {f.__name__} is registered twice")
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _fill() -> None:
    from .plans import queries, stores, whole  # noqa: F401  registers them


def queries() -> dict[str, Query]:
    _fill()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _fill()
    return dict(_SQL)
