"""Every operator as a named query over the given tables, with its SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkscope.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PARTS = (
    "io_queries",
    "filter_queries",
    "transform_queries",
    "enrich_queries",
    "quality_queries",
    "relational_queries",
    "aggregate_queries",
    "series_queries",
    "cluster_queries",
    "stream_queries",
    "alert_queries",
    "report_queries",
    "search_queries",
    "function_queries",
    "ingest_queries",
)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its DuckDB twin."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return add


def load() -> None:
    for part in PARTS:
        importlib.import_module(f"sparkscope.catalog.{part}")
