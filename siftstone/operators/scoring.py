"""Quality score, KPI cards, rule-based insights and recommendations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import grade, ref
from .profiling import TableProfile

# Weights of the quality dimensions.
QUALITY_WEIGHTS = {"completeness": 0.40, "consistency": 0.30, "validity": 0.20, "timeliness": 0.10}


def quality_score(profile: TableProfile) -> DataFrame:
    """One row: the four dimensions, the weighted score and its grade."""
    facts = profile.columns.agg(
        F.struct(
            F.coalesce(F.round(F.avg(F.when(F.col("null_rate") < 0.20, 1.0).otherwise(0.0)), 4), F.lit(1.0)).alias("v"),
            F.coalesce(F.bool_or(F.col("kind") == "datetime"), F.lit(False)).alias("t"),
        )
    ).scalar()
    scored = profile.table.withColumn("_f", facts).select(
        F.col("completeness_score").alias("completeness"),
        F.col("consistency_score").alias("consistency"),
        F.col("_f.v").alias("validity"),
        F.when(F.col("_f.t"), 1.0).otherwise(0.5).alias("timeliness"),
    )
    total = sum((F.col(c) * w for c, w in list(QUALITY_WEIGHTS.items())[1:]),
                F.col("completeness") * QUALITY_WEIGHTS["completeness"])
    return scored.withColumn("overall_score", F.round(total, 4)).withColumn(
        "grade", grade(F.col("overall_score"))
    )


def kpi_cards(profile: TableProfile, max_column_cards: int = 10, consistency: bool = True,
              total_cap: int | None = None) -> DataFrame:
    """Headline cards in order: table facts, then the mean of the currency columns.

    ``consistency=False, total_cap=10`` gives the shorter card set.
    """
    def card(position, name, value, unit, form, benchmark=None):
        return F.struct(
            F.lit(position).alias("position"), F.lit(name).alias("name"), value.cast("double").alias("value"),
            F.lit(unit).alias("unit"), F.lit(form).alias("format"),
            F.lit(benchmark).cast("double").alias("benchmark"),
        )

    cards = [
        card(1, "Total Rows", F.col("row_count"), "rows", "integer"),
        card(2, "Columns", F.col("column_count"), "cols", "integer"),
        card(3, "Completeness", F.round(F.col("completeness_score") * 100, 1), "%", "percent", 95.0),
    ]
    if consistency:
        cards.append(card(4, "Consistency", F.round(F.col("consistency_score") * 100, 1), "%", "percent", 95.0))
    cards.append(card(5, "Duplicate Rows", F.col("duplicate_count"), "rows", "integer"))
    table = profile.table.select(F.inline(F.array(*cards)))
    money = profile.columns.where((F.col("semantic_type") == "currency") & F.col("mean").isNotNull())
    if total_cap is not None:
        max_column_cards = max(0, total_cap - len(cards))
    averages = money.orderBy("ordinal").limit(max_column_cards).select(
        (F.col("ordinal") + 6).alias("position"),
        F.concat(F.lit("Avg "), F.col("column_name")).alias("name"),
        F.round("mean", 2).alias("value"),
        F.lit("").alias("unit"),
        F.lit("currency").alias("format"),
        F.lit(None).cast("double").alias("benchmark"),
    )
    return table.unionByName(averages)


def percent_text(share: Column) -> Column:
    return F.concat(F.format_number(share * 100, 1), F.lit("%"))


def basic_insights(table: DataFrame) -> DataFrame:
    """Size, completeness and duplicates as insights (one row of the table profile in, up to three out)."""
    def insight(position, headline, explanation, impact):
        return F.struct(
            F.lit(position).alias("position"), headline.alias("headline"), F.lit(explanation).alias("explanation"),
            impact.alias("business_impact"), F.lit(1.0).alias("confidence"),
            F.array().cast("array<string>").alias("source_columns"),
        )

    size = F.concat(
        F.lit("Dataset contains "), F.format_number(F.col("row_count"), 0), F.lit(" rows across "),
        F.col("column_count").cast("string"), F.lit(" columns"),
    )
    complete = F.concat(F.lit("Data completeness is "), percent_text(F.col("completeness_score")))
    repeats = F.concat(F.format_number(F.col("duplicate_count"), 0), F.lit(" duplicate rows detected"))
    items = F.array(
        insight(1, size, "Basic dataset dimensions are confirmed and ready for analysis.", F.lit("medium")),
        insight(2, complete, "This measures the proportion of non-null values across all fields.",
                F.when(F.col("completeness_score") < 0.90, "high").otherwise("low")),
        insight(3, repeats, "Duplicate records were found and removed during data cleaning.", F.lit("medium")),
    )
    return table.select("duplicate_count", F.inline(items)).where(
        (F.col("position") < 3) | (F.col("duplicate_count") > 0)
    ).drop("duplicate_count")


def summary_sentence(table: DataFrame, insights: DataFrame | None = None) -> DataFrame:
    """One sentence about the table, with the headline of the first insight."""
    top = F.lit("No significant findings")
    if insights is not None:
        top = F.coalesce(insights.agg(F.min_by("headline", "position")).scalar(), top)
    return table.withColumn("_top", top).select(
        F.concat(
            F.lit("The dataset contains "), F.format_number(F.col("row_count"), 0), F.lit(" rows and "),
            F.col("column_count").cast("string"), F.lit(" columns with a completeness score of "),
            percent_text(F.col("completeness_score")), F.lit(". Key finding: "), F.col("_top"), F.lit("."),
        ).alias("summary")
    )


def estimate_impact(
    df: DataFrame,
    priority: str = "priority",
    semantic_type: str | None = "semantic_type",
    confidence: str | None = "confidence",
    anomaly_count: str | None = None,
    trend: str | None = None,
) -> DataFrame:
    """Adds ``min_pct, max_pct, label, impact_confidence`` to recommendation rows.

    A column name of None stands for "not known".
    """
    level = F.lower(F.coalesce(ref(priority), F.lit("medium")))

    def by_level(index):
        return (
            F.when(level == "high", fixed.IMPACT_RANGES["high"][index])
            .when(level == "low", fixed.IMPACT_RANGES["low"][index])
            .otherwise(fixed.IMPACT_RANGES["medium"][index])
        )

    low, high = by_level(0), by_level(1)
    if semantic_type:
        factor = F.lit(1.0)
        for name, value in fixed.IMPACT_FACTORS.items():
            factor = F.when(ref(semantic_type) == name, value).otherwise(factor)
        low, high = F.round(low * factor, 1), F.round(high * factor, 1)
    if anomaly_count:
        many = F.coalesce(ref(anomaly_count) > 10, F.lit(False))
        low = F.when(many, F.round(low * 1.2, 1)).otherwise(low)
        high = F.when(many, F.round(high * 1.2, 1)).otherwise(high)
    if trend:
        high = F.when(ref(trend) == "up", F.round(high * 1.15, 1)).otherwise(high)
        low = F.when(ref(trend) == "down", F.round(low * 1.10, 1)).otherwise(low)
    sure = F.lit(0.75)
    if confidence:
        sure = F.least(F.lit(0.90), F.coalesce(ref(confidence), F.lit(0.75)))
    return df.withColumns(
        {"min_pct": low, "max_pct": high, "label": by_level(2), "impact_confidence": sure}
    )


def match_insights(recommendations: DataFrame, insights: DataFrame, by: Sequence[str] = (), rank: str = "position") -> DataFrame:
    """One recommendation to one insight by explicit rank (an equi-join, not row order)."""
    keys = [*by, rank]
    extra = [c for c in insights.columns if c in recommendations.columns and c not in keys]
    return recommendations.join(insights.drop(*extra), keys, "left")


def with_types(df: DataFrame, columns: DataFrame, name: str = "column_name") -> DataFrame:
    """Semantic type and key flag looked up by column name.

    The lookup side has one row per table column, so it is broadcast.
    """
    wanted = [c for c in ("semantic_type", "kind", "is_primary_key") if c in columns.columns]
    lookup = columns.select(F.col("column_name").alias("_name"), *wanted)
    return df.join(F.broadcast(lookup), ref(name) == F.col("_name"), "left").drop("_name")


def basic_recommendations(insights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One recommendation from the first insight of each dataset."""
    top = insights.groupBy(*[ref(c) for c in by]).agg(
        F.min_by(F.struct("headline", "business_impact", "explanation"), "position").alias("t")
    )
    return top.where(F.col("t").isNotNull()).select(
        *[ref(c) for c in by],
        F.concat(F.lit("Address: "), F.substring("t.headline", 1, 40)).alias("title"),
        F.coalesce("t.business_impact", F.lit("medium")).alias("priority"),
        F.substring(F.coalesce("t.explanation", F.lit("")), 1, 150).alias("situation"),
        F.lit("Review this finding with your data team and define next steps.").alias("action"),
    )


def priority_order(priority: Column) -> Column:
    return F.when(priority == "high", 0).when(priority == "medium", 1).otherwise(2)


def ordered_recommendations(df: DataFrame) -> DataFrame:
    return df.orderBy(priority_order(F.col("priority")), "title")


# ── report tables ───────────────────────────────────────────────────────────

#: Caps of the printed report.
PRINTED = {"max_kpis": 10, "max_anomalies": 200, "max_series": 3, "max_points": 365}


def report_tables(
    kpis: DataFrame,
    insights: DataFrame,
    anomalies: DataFrame,
    recommendations: DataFrame,
    forecasts: DataFrame | None = None,
    key: Sequence[str] = (),
    max_kpis: int | None = None,
    max_anomalies: int | None = None,
    max_series: int | None = None,
    max_points: int | None = None,
) -> dict[str, DataFrame]:
    """The sections of a report with the columns of the printed one, whole where no cap is given (``PRINTED`` has its caps)."""
    from ..functions.columns import severity_rank

    def first(df, n):
        return df if n is None else df.limit(n)

    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("position"))
    out = {
        "kpis": first(kpis.orderBy("position"), max_kpis).select(F.col("name").alias("metric"), "value"),
        "insights": insights.select(
            number.alias("number"), "headline", F.upper("business_impact").alias("business_impact"),
            F.concat(F.format_number(F.col("confidence") * 100, 0), F.lit("%")).alias("confidence"),
            F.concat_ws(", ", "source_columns").alias("source_columns"),
        ),
        "anomalies": first(anomalies.orderBy(
            severity_rank(F.col("severity")), F.desc("confidence"), "column", *[ref(k) for k in key]
        ), max_anomalies).select(
            "column", F.col("anomaly_type").alias("type"), F.upper("severity").alias("severity"),
            F.concat_ws(",", *[ref(k).cast("string") for k in key]).alias("row_key"), "value", "description",
        ),
        "recommendations": recommendations.orderBy(priority_order(F.col("priority"))).select(
            F.upper("priority").alias("priority"), "title", "situation", "action"
        ),
    }
    if forecasts is not None:
        if max_series is not None:
            series = forecasts.select("series").distinct().orderBy("series").limit(max_series)
            forecasts = forecasts.join(series, "series", "left_semi")
        if max_points is not None:
            order = Window.partitionBy("series").orderBy("ts")
            forecasts = forecasts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_points)
        out["forecasts"] = (
            forecasts.select("series", F.col("ts").alias("date"), F.col("value").alias("forecast"), "lower", "upper")
        )
    return out
