"""All queries of the core, by name, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkyard.plans import data_queries, detection_queries, evaluate_queries, image_queries, label_queries, pair_queries, rebalance_queries, validate_queries

MODULES = [data_queries, label_queries, image_queries, pair_queries, rebalance_queries, evaluate_queries, detection_queries, validate_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
