"""All queries of the engine by name, with DuckDB SQL for their results."""

from __future__ import annotations

from . import backtests, market, reports, research  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, sf_dir):
    return backtests.portfolio_every_bar(spark, sf_dir)
