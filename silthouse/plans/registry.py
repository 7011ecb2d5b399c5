"""Every registered query of the engine, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under a name, with its oracle SQL if there is one."""

    def put(f: Query) -> Query:
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _loaded() -> None:
    """The modules that register queries when they are imported."""
    for name in ("archive", "analysis", "entities", "texts", "records", "spine", "cells", "files", "streams"):
        importlib.import_module(f"silthouse.plans.{name}")


def queries() -> dict[str, Query]:
    _loaded()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _loaded()
    return _SQL
