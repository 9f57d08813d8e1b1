"""Registry of named queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.plans.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``views`` are put before the oracle SQL."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle, *views) if views else oracle.strip()
        return fn

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Round the named double columns, as the oracle does, to hide summation order."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
