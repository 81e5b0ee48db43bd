"""Reading the given tables and small helpers for the registered queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """Doubles rounded so that the order of summation does not show."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
