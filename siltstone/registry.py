"""All queries outside the corpus subpackage by name, with their DuckDB SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


def load_all() -> None:
    """Import the modules that register queries."""
    from siltstone.plans import commerce, corrections, derived, detect, events, frontier, layout, machines, models, pages, relational, reports, urls  # noqa: F401
    from siltstone.streaming import plans  # noqa: F401
