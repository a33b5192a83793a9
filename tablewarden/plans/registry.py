"""Registered queries: each takes the derived views and is paired with DuckDB text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tablewarden.plans.views import Views, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_MODULES = [
    "lineage_queries", "extract_queries", "quality_queries", "delta_queries", "delta_file_queries", "ingest_queries", "classify_queries",
    "contract_queries", "alert_queries", "usage_queries", "audit_queries", "catalog_queries", "search_queries",
    "request_queries", "stream_queries",
]


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name``."""

    def wrap(fn):
        QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return wrap


def alias(name: str, of: str) -> None:
    """Register a query under a second name."""
    QUERIES[name], ORACLES[name] = QUERIES[of], ORACLES[of]


def load_all() -> None:
    for m in _MODULES:
        import_module(f"tablewarden.plans.{m}")
