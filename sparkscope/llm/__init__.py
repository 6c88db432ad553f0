"""Operators of a training-data pipeline; nothing else in the library imports them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkscope.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PARTS = (
    "tokens",
    "bpe",
    "topk",
    "substring",
    "chat",
    "sharding",
    "packing",
    "exact",
    "quality",
    "near",
    "lines",
    "phrases",
    "whiten",
)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its DuckDB twin."""

    def add(fn):
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
        importlib.import_module(f"sparkscope.llm.{part}")
