"""Collects queries by id with the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers f(views) -> DataFrame under its name; ``sql`` is the equivalent DuckDB statement, over the whole tables too."""

    def put(f: Callable[[Views], DataFrame]):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[key] = sql
        return f

    return put
