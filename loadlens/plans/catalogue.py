"""All registered queries."""

from __future__ import annotations

from loadlens.plans import (  # noqa: F401
    energy_queries,
    evaluation_queries,
    fit_queries,
    model_queries,
    ranking_queries,
    series_queries,
    table_queries,
)
from loadlens.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
