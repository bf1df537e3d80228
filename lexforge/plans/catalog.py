"""All queries by name, with the SQL that states each independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL where SQL can state it."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    import importlib

    for name in MODULES:
        importlib.import_module(f"lexforge.plans.{name}")


MODULES = ("corpus", "platform", "more", "derived", "survey")
FLAGSHIP_NAME = "cql_sequence"


def FLAGSHIP(spark: SparkSession, d: str) -> DataFrame:  # noqa: N802
    return queries()[FLAGSHIP_NAME](spark, d)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
