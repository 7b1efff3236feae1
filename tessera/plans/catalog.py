"""Registered queries: key -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or fixture views derived from them by
Spark) in full; no row caps, id subsets or sampling, except where a limit *is*
the operator (top-k reports, previews).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(key: str):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        return fn
    return deco


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    # Import the modules that register queries (order = registration order).
    from tessera.plans import q_trend, q_groups, q_profile, q_clean, q_eda, q_kpi, q_stats, q_ml, q_questions, q_sources  # noqa: F401
    return dict(QUERIES)
