"""The registry of queries and the SQL each is checked against."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import bounded_tasks
from .oracle import BASE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None, base: str = BASE):
    """Register a query under its name, with the SQL that gives the same rows."""

    def add(f):
        @functools.wraps(f)
        def run(spark, d):
            bounded_tasks(spark, d)
            return f(spark, d)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = base + sql
        return f

    return add
