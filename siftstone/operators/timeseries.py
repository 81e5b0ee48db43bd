"""Period summaries and datetime profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import moment, number, ref
from .ordered import cut_points, previous_rows, with_bucket
from .quantiles import column_quantiles

_PERIOD_AGGREGATES = {"SUM": F.sum, "AVG": F.avg, "COUNT": F.count, "MAX": F.max, "MIN": F.min}


def choose_granularity(df: DataFrame, ts: str) -> str:
    """day, week, month, quarter or year by the span of the column (one row is read)."""
    at = moment(df, ts)
    days = df.agg(F.datediff(F.max(at), F.min(at))).first()[0] or 0
    if days < 60:
        return "day"
    if days < 26 * 7:
        return "week"
    if days < 36 * 30.4375:
        return "month"
    if days < 20 * 91.3125:
        return "quarter"
    return "year"


def period_totals(
    df: DataFrame, ts: str, value: str, granularity: str, func: str = "SUM", by: Sequence[str] = ()
) -> DataFrame:
    """One row per series and period: the only step that sees every input row."""
    if func.upper() not in _PERIOD_AGGREGATES:
        raise ValueError(f"unsupported aggregate: {func!r}")
    data = df.select(
        *[ref(c) for c in by],
        F.date_trunc(granularity, moment(df, ts)).alias("period"),
        number(df, value).alias("_v"),
    ).where(F.col("period").isNotNull() & F.col("_v").isNotNull())
    return data.groupBy(*by, "period").agg(
        _PERIOD_AGGREGATES[func.upper()]("_v").cast("double").alias("period_value"),
        F.count("*").alias("row_count"),
        F.avg("_v").alias("period_avg"),
        F.min("_v").alias("period_min"),
        F.max("_v").alias("period_max"),
        F.stddev_pop("_v").alias("period_stddev"),
    )


def period_summary(
    df: DataFrame,
    ts: str,
    value: str,
    granularity: str | None = None,
    func: str = "SUM",
    by: Sequence[str] = (),
) -> DataFrame:
    """Per period: value, change, running total, rolling average and the series' trend.

    Windows run over the aggregated periods (a few thousand rows per series).
    """
    by = list(by)
    granularity = granularity or choose_granularity(df, ts)
    periods = period_totals(df, ts, value, granularity, func, by)
    series = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    order = series.orderBy("period")
    v = F.col("period_value")
    previous = F.lag("period_value").over(order)
    seconds = F.unix_seconds("period").cast("double")
    return (
        periods.withColumn("_prev", previous)
        .withColumn("_seconds", seconds)
        .withColumn("_running", F.sum(v).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_rolling", F.avg(v).over(order.rowsBetween(-2, 0)))
        .withColumn("period_rank", F.rank().over(order))
        .withColumn("total_periods", F.count("*").over(series))
        .withColumn("series_start", F.min("period").over(series))
        .withColumn("series_end", F.max("period").over(series))
        .withColumn("series_total", F.sum(v).over(series))
        .withColumn("series_avg", F.avg(v).over(series))
        .withColumn("series_max", F.max(v).over(series))
        .withColumn("series_min", F.min(v).over(series))
        .withColumn("_slope", F.regr_slope(v, F.col("_seconds")).over(series))
        .withColumn("_r2", F.regr_r2(v, F.col("_seconds")).over(series))
        .select(
            *by,
            F.date_format("period", "yyyy-MM-dd'T'HH:mm:ss").alias("period_iso"),
            "period",
            "period_rank",
            "total_periods",
            F.round(v, 4).alias("value"),
            "row_count",
            F.round("period_avg", 4).alias("avg_value"),
            F.round("period_min", 4).alias("min_value"),
            F.round("period_max", 4).alias("max_value"),
            F.round("period_stddev", 4).alias("stddev_value"),
            F.round("_prev", 4).alias("prev_value"),
            F.round(v - F.col("_prev"), 4).alias("abs_change"),
            F.round(100.0 * (v - F.col("_prev")) / F.nullif(F.col("_prev"), F.lit(0.0)), 2).alias("pct_change"),
            F.round("_rolling", 4).alias("rolling_3_avg"),
            F.round("_running", 4).alias("running_total"),
            "series_start",
            "series_end",
            F.round("series_total", 4).alias("series_total"),
            F.round("series_avg", 4).alias("series_avg"),
            F.round("series_max", 4).alias("series_max"),
            F.round("series_min", 4).alias("series_min"),
            F.round("_slope", 8).alias("trend_slope"),
            F.round("_r2", 4).alias("trend_r2"),
            F.when(F.col("_slope") > 0, "up").when(F.col("_slope") < 0, "down").otherwise("flat").alias(
                "trend_direction"
            ),
        )
    )


def datetime_profile(df: DataFrame, column: str, task_rows: int | None = None) -> DataFrame:
    """Range, number of values, typical frequency and gaps of one datetime column.

    Gaps are taken between neighbouring distinct values; the neighbour search
    runs per time slice with one carried row per slice.
    """
    micros = F.unix_micros(moment(df, column))
    counted = (
        df.select(micros.alias("t")).where(F.col("t").isNotNull()).groupBy("t").agg(F.count("*").alias("c"))
    )
    facts = counted.agg(
        F.min("t").alias("lo"), F.max("t").alias("hi"), F.sum("c").alias("n"), F.count("*").alias("u")
    )
    known = facts.first()
    day = 86_400_000_000.0
    cuts = cut_points(counted, "t", known.u, task_rows)
    placed = with_bucket(counted.select("t"), "t", cuts)
    before = previous_rows(placed, [], F.col("_bucket"), ["t"], ["t"])
    gaps = before.where(F.col("prev_t").isNotNull()).select(((F.col("t") - F.col("prev_t")) / day).alias("gap"))
    median = column_quantiles(gaps, ["gap"], [0.5], rows=max(known.u - 1, 0)).select(F.col("q")[0].alias("m"))
    widest = gaps.agg(F.max("gap").alias("g"))
    m, enough = F.col("m"), F.lit(known.u > 2)
    frequency = (
        F.when(~enough | m.isNull(), "unknown")
        .when(m <= 1.5, "daily")
        .when(m <= 8, "weekly")
        .when(m <= 16, "bi-weekly")
        .when(m <= 35, "monthly")
        .when(m <= 100, "quarterly")
        .otherwise("annual_or_irregular")
    )
    stamp = lambda t: F.date_format(F.timestamp_micros(F.col(t)), "yyyy-MM-dd'T'HH:mm:ss")
    return (
        facts.withColumn("m", median.scalar())
        .withColumn("g", widest.scalar())
        .where(F.col("n").isNotNull())
        .select(
            F.lit(column).alias("column_name"),
            stamp("lo").alias("min_date"),
            stamp("hi").alias("max_date"),
            F.floor((F.col("hi") - F.col("lo")) / day).cast("int").alias("date_range_days"),
            F.col("n").alias("non_null_count"),
            F.col("u").alias("unique_dates"),
            frequency.alias("inferred_frequency"),
            F.coalesce(enough & (F.col("g") > 2 * m), F.lit(False)).alias("has_gaps"),
        )
    )
