"""Every registered query of the library, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return put


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from tracewright.plans import board_queries, copper_queries, evidence_queries, graph_queries, inference_queries, quality_queries, scalar_queries, source_queries, tool_queries  # noqa: F401

    return QUERIES, SQL
