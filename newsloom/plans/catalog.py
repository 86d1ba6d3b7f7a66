"""Registry of the driver queries: name -> (Spark function, DuckDB SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def load_all() -> None:
    """Import every module that registers queries."""
    from newsloom.plans import (  # noqa: F401
        ingest_queries,
        listing_queries,
        search_queries,
        stats_queries,
        stream_queries,
        text_queries,
    )
