"""All registered queries and oracles by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import model_queries, operations_queries, quality_queries, statistics_queries, text_queries

_MODULES = [statistics_queries, quality_queries, text_queries, operations_queries, model_queries]


def _in_utc(run: Callable[[SparkSession, str], DataFrame]):
    """Timestamps without zone are read as UTC whatever the machine's zone."""

    @wraps(run)
    def call(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return run(spark, folder)

    return call


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _in_utc(run) for module in _MODULES for name, run in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
