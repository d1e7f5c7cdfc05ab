"""All named queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracefold.plans.base import QUERIES, SQL
from tracefold.plans import audit, board, catalog, community, decisions, discovery, evidence, facts, folds, incremental, intake, investors, pages, portfolio, quality, records, relations, relevance, resolution, reviews, rules, upkeep  # noqa: F401, E402  each registers its queries

Query = Callable[[SparkSession, str], DataFrame]
__all__ = ["QUERIES", "SQL", "Query"]
