"""Where registered queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None):
    def keep(f: Query) -> Query:
        _all[f.__name__] = f, sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _all.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all.items() if sql}
