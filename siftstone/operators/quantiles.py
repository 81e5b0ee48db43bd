"""Exact interpolated quantiles without one buffer or one task per group.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation
buffer. Here equal values are first counted (merging map-side), then the wanted
ranks are looked up in running counts. A table larger than one task's share is
cut into value buckets; only the buckets that hold a wanted rank are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import join_null_safe, long_form, number, ref
from .ordered import TASK_ROWS, cut_points, with_bucket


def shared_cuts(df: DataFrame, columns: Sequence[str], rows: int, task_rows: int | None = None) -> list[float]:
    """Cut points for several columns in long form: the union of their approximate quantiles.

    Buckets stay in value order within every column. One scan, no shuffle of
    rows; one number per column and task reaches the driver. A sample of about 2,000
    rows per bucket is enough: the cut points only balance the work.
    """
    buckets = math.ceil(rows / (task_rows or TASK_ROWS))
    if buckets <= 1:
        return []
    inner = [i / buckets for i in range(1, buckets)]
    sample = df.sample(fraction=min(1.0, 2000 * buckets / rows), seed=42)
    row = sample.agg(
        *[F.percentile_approx(number(df, c), inner, 10 * buckets).alias(f"c{i}") for i, c in enumerate(columns)]
    ).first()
    return sorted({v for cuts in row if cuts for v in cuts})


def column_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    shares: Sequence[float],
    approx: bool = False,
    rows: int | None = None,
    task_rows: int | None = None,
) -> DataFrame:
    """One row per column: ``column_name, q`` (array of quantiles in the order of ``shares``).

    Columns without a value are left out. ``rows`` may pass a known row count;
    else the rows are counted (a Parquet scan answers that from its footers).
    """
    columns, shares = list(columns), [float(s) for s in shares]
    if approx:
        wide = df.agg(
            *[F.percentile_approx(number(df, c), shares, 100_000).alias(f"q{i}") for i, c in enumerate(columns)]
        )
        pairs = [F.struct(F.lit(c).alias("column_name"), F.col(f"q{i}").alias("q")) for i, c in enumerate(columns)]
        return wide.select(F.inline(F.array(*pairs))).where(F.col("q").isNotNull())
    cuts = shared_cuts(df, columns, df.count() if rows is None else rows, task_rows)
    counted = (
        long_form(df, columns, number)
        .where(F.col("value").isNotNull())
        .groupBy("column_name", F.col("value").alias("v"))
        .agg(F.count("*").alias("n"))
    )
    return counted_quantiles(counted, ["column_name"], shares, cuts)


def grouped_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    shares: Sequence[float],
    task_rows: int | None = None,
) -> DataFrame:
    """One row per group with a value: the group columns and ``q``."""
    by = list(by)
    data = df.select(*[ref(c) for c in by], number(df, value).alias("v")).where(F.col("v").isNotNull())
    cuts = cut_points(data, "v", data.count(), task_rows)
    counted = data.groupBy(*by, "v").agg(F.count("*").alias("n"))
    return counted_quantiles(counted, by, [float(s) for s in shares], cuts)


def counted_quantiles(
    counted: DataFrame, by: Sequence[str], shares: Sequence[float], cuts: Sequence[float] = (), distinct: bool = False
) -> DataFrame:
    """Quantiles of a value-count relation (``by…, v, n``, one row per distinct value); with ``distinct`` also ``unique_count``, its rows."""
    by = list(by)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    total = F.col("_total")

    def positions(share):
        at = (total - 1) * F.lit(share)
        return at, F.floor(at), F.ceil(at)

    if cuts:
        placed = with_bucket(counted, "v", cuts)
        cells = (
            placed.groupBy(*by, "_bucket")
            .agg(F.sum("n").alias("_cell"), F.count("*").alias("_rows"))
            .withColumn("_total", F.sum("_cell").over(group))
            .withColumn("_distinct", F.sum("_rows").over(group))
            .withColumn(
                "_start",
                F.coalesce(
                    F.sum("_cell").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
                    F.lit(0),
                ),
            )
        )
        wanted = F.lit(False)
        for share in shares:
            _, low, high = positions(share)
            for rank in (low, high):
                wanted = wanted | ((rank >= F.col("_start")) & (rank < F.col("_start") + F.col("_cell")))
        cells = cells.where(wanted).select(*by, "_bucket", "_start", "_total", "_distinct")
        values = join_null_safe(placed, cells, [*by, "_bucket"])
        inside = Window.partitionBy(*by, "_bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        values = values.withColumn("_end", F.col("_start") + F.sum("n").over(inside))
    else:
        running = group.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        values = counted.withColumn("_end", F.sum("n").over(running)).withColumn("_total", F.sum("n").over(group))
        values = values.withColumn("_distinct", F.count("*").over(group))
    begin, end = F.col("_end") - F.col("n"), F.col("_end")

    picks = [F.max("_total").alias("_total"), F.max("_distinct").alias("unique_count")]
    useful = F.lit(False)
    for i, share in enumerate(shares):
        _, low, high = positions(share)
        for side, rank in (("lo", low), ("hi", high)):
            covered = (rank >= begin) & (rank < end)
            useful = useful | covered
            picks.append(F.max(F.when(covered, F.col("v"))).alias(f"_{side}{i}"))
    found = values.where(useful).groupBy(*by).agg(*picks)
    quantiles = []
    for i, share in enumerate(shares):
        at, low, _ = positions(share)
        quantiles.append(F.col(f"_lo{i}") + (at - low) * (F.col(f"_hi{i}") - F.col(f"_lo{i}")))
    return found.select(*by, F.array(*quantiles).alias("q"), *(["unique_count"] if distinct else []))
