"""The list of bound queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rolecall.workload.tables import Tables, duck

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Bind a function of the tables under ``name``; ``sql`` states its result for DuckDB."""

    def bind(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name} is bound twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return bind


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from rolecall.workload import (  # noqa: F401 - importing binds the queries
        cleaning,
        collecting,
        matching,
        reporting,
        tracking,
    )

    def callable_for(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: fn(Tables(spark, folder))

    return {name: callable_for(fn) for name, fn in _QUERIES.items()}


def all_sql() -> dict[str, str]:
    all_queries()
    return dict(_SQL)


__all__ = ["all_queries", "all_sql", "duck", "query"]
