"""Registration of named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without `sql` it is checked by its rows only."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load_all() -> None:
    from . import (  # noqa: F401
        detail_queries, feeds_and_places, hotspot_queries, quality_queries, record_queries, registry_queries, rollup_queries,
        series_queries, settling_queries, sink_queries, spatial_queries, stream_queries,
    )
