"""Registry of queries: Spark callable plus reference SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ticketlens.plans.views import reference_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
REFERENCE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name; the SQL text may use every view of plans.views."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            REFERENCE[name] = reference_sql(sql)
        return fn

    return register
