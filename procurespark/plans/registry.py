"""Where queries and their DuckDB SQL are registered."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def load() -> None:
    """Registers the queries of all modules of this package."""
    for module in ("queries", "read_queries", "ingest_queries", "payload_queries"):
        import_module(f"procurespark.plans.{module}")
