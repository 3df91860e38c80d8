"""Registered queries, each with its SQL where the result can be told in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def oracles() -> dict[str, str]:
    """The SQL of every query behind its views; built on demand, nothing is read at import."""
    from checks.views_sql import with_views

    return {name: with_views(sql) for name, sql in ORACLES.items()}
