"""The named queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oscine.plans import board_queries, detection_queries, generated_queries, package_queries, relational_queries, rule_queries, shift_queries, signal_queries, spectral_queries, statistics_queries, trial_queries, verdict_queries

MODULES = (signal_queries, detection_queries, statistics_queries, spectral_queries, relational_queries, generated_queries, trial_queries, board_queries, package_queries, rule_queries, shift_queries, verdict_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
