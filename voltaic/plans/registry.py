"""Queries by name, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under a name."""

    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return add


def _load() -> None:
    """The modules that register queries."""
    from voltaic.plans import assurance, climate, contracts, details, detection, experiments, extensions, governance, metering, overview, relational, repository, series, signals, streams, timeline  # noqa: F401


_load()
