"""Name -> query and name -> oracle SQL for the document-graph engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function as the query of its name; `oracle` is DuckDB SQL for the same rows."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if oracle:
            ORACLES[run.__name__] = oracle
        return run

    return add


from strataweave.plans import (  # noqa: E402, F401  registers the queries
    content_queries,
    drift_queries,
    extraction_queries,
    graph_queries,
    quality_queries,
    resolution_queries,
)
