"""All queries of the engine by name, and the DuckDB SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under ``name``."""

    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def load() -> None:
    """Import the modules that register queries."""
    from terraloom.plans import fields, graphs, ranking, spatial  # noqa: F401


load()
