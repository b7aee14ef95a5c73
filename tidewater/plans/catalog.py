"""Registry of named queries and their DuckDB oracle twins.

Each query is ``(spark, sf_dir) -> DataFrame`` over the driver tables (or
inputs Spark derives from them). Its oracle, when the semantics are
SQL-expressible, is one DuckDB statement over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: register a query (and optionally its oracle SQL)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name!r}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


def load_all() -> None:
    """Import every query module so their registrations run."""
    from . import (  # noqa: F401
        framing_queries,
        parsing_queries,
        spool_queries,
        packing_queries,
        config_queries,
        monitor_queries,
        naming_queries,
        flow_queries,
        stream_queries,
        io_queries,
    )
