"""Every query with its SQL, by operator id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = ("urls", "html", "dedupe", "frontier", "health", "archive", "exact", "more")


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under ``name``, with the SQL that gives the same rows."""

    def put(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    import importlib

    for m in _MODULES:
        importlib.import_module(f"webloom.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
