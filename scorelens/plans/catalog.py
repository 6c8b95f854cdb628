"""Registry of runnable queries and, where SQL can say the same, their SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def load_all() -> None:
    from scorelens.plans import (  # noqa: F401
        drift_queries,
        evaluate_queries,
        feature_queries,
        io_queries,
        job_queries,
        log_queries,
        model_queries,
        quality_queries,
        slo_queries,
        stream_queries,
    )
