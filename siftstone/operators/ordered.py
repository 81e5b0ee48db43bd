"""Order-dependent work over a whole table without an unpartitioned window.

Values are cut into balanced buckets at approximate quantiles. Windows then run
inside one bucket, and one small row per bucket carries the running state from
bucket to bucket. Results are exact: the cut points only decide where work runs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import join_null_safe

# Rows one task is asked to sort in a window; more rows mean more buckets.
TASK_ROWS = 2_000_000


def cut_points(df: DataFrame, column: str, rows: int, task_rows: int | None = None) -> list[float]:
    """Approximate quantiles of a numeric column; none when the rows fit one task.

    Taken from a sample, as they only balance the work. Only the cut points, one
    per task, reach the driver.
    """
    buckets = math.ceil(rows / (task_rows or TASK_ROWS))
    if buckets <= 1:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    row = df.sample(fraction=min(1.0, 2000 * buckets / rows), seed=42).agg(
        F.percentile_approx(F.col(column).cast("double"), shares, 10 * buckets).alias("cuts")
    ).first()
    return sorted(set(row.cuts or []))


def with_bucket(df: DataFrame, column: str, cuts: Sequence[float], name: str = "_bucket") -> DataFrame:
    """Adds the bucket number of a numeric, non-null column."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    edges = [-math.inf, *cuts, math.inf]
    return (
        Bucketizer(splits=edges, inputCol="_cut_value", outputCol="_cut_bucket")
        .transform(df.withColumn("_cut_value", F.col(column).cast("double")))
        .withColumn(name, F.col("_cut_bucket").cast("int"))
        .drop("_cut_value", "_cut_bucket")
    )


def running_total(
    df: DataFrame,
    order_column: str,
    weight: str,
    cuts: Sequence[float],
    by: Sequence[str] = (),
    name: str = "before",
) -> DataFrame:
    """Adds the sum of ``weight`` over all rows ordered strictly before this one.

    ``df`` holds one row per (by, order_column), so equal values are already
    pre-aggregated and a frequent value is a single row.
    """
    by = list(by)
    placed = with_bucket(df, order_column, cuts)
    inside = Window.partitionBy(*by, "_bucket").orderBy(order_column).rowsBetween(
        Window.unboundedPreceding, -1
    )
    local = placed.withColumn("_local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    if not cuts:
        return local.withColumn(name, F.col("_local")).drop("_local", "_bucket")
    # One row per (by, bucket): the window below sees a row per task's share.
    chain = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = (
        placed.groupBy(*by, "_bucket")
        .agg(F.sum(weight).alias("_in_bucket"))
        .withColumn(
            "_earlier",
            F.coalesce(
                F.sum("_in_bucket").over(
                    chain.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_in_bucket")
    )
    # without groups a row per task: the running rows stay where they are
    return join_null_safe(local, earlier if by else F.broadcast(earlier), [*by, "_bucket"]).select(
        *df.columns, (F.col("_local") + F.col("_earlier")).alias(name)
    )


def previous_rows(
    df: DataFrame,
    by: Sequence[str],
    bucket_of: Column,
    order_columns: Sequence[str],
    carried: Sequence[str],
    prefix: str = "prev_",
) -> DataFrame:
    """``lag(…)`` per key, safe for a key that holds a large part of the table.

    ``bucket_of`` is a coarse, order-preserving slice of the leading order
    column (an hour, a day, a cut-point bucket). The window runs per (key,
    slice); the last row of each slice is passed on through a table with one
    row per (key, slice).
    """
    by, carried = list(by), list(carried)
    placed = df.withColumn("_slice", bucket_of)
    inside = Window.partitionBy(*by, "_slice").orderBy(*order_columns)
    local = placed.select(
        "*", F.lag(F.struct(*carried)).over(inside).alias("_inside")
    )
    keyed = F.struct(*order_columns)
    last = placed.groupBy(*by, "_slice").agg(F.max_by(F.struct(*carried), keyed).alias("_last"))
    chain = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    last = last.select(
        *by, "_slice", F.lag("_last").over(chain.orderBy("_slice")).alias("_handed_on")
    )
    known = F.coalesce(F.col("_inside"), F.col("_handed_on"))
    return join_null_safe(local, last, [*by, "_slice"], "left").select(
        *df.columns, *[known[c].alias(prefix + c) for c in carried]
    )
