"""Registered queries: forecasts and baseline models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecasting, forest, learning, operations
from .tables import table

QUERIES, ORACLES = {}, {}


def register(name, run, sql=None):
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def _orders_daily(spark, sf):
    return forecasting.daily_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", ["o_orderpriority"])


def _events_daily(spark, sf):
    return forecasting.daily_series(table(spark, sf, "events"), "ts", "value", ["event_type"])


register(
    "daily_series",
    lambda spark, sf: _events_daily(spark, sf).select(
        "series", F.date_format("ts", "yyyy-MM-dd").alias("ts"), F.round("y", 4).alias("y")
    ),
    """SELECT event_type AS series, STRFTIME(date_trunc('day', ts), '%Y-%m-%d') AS ts, ROUND(SUM(value), 4) AS y FROM events GROUP BY ALL""",
)
register(
    "lag_features",
    lambda spark, sf: forecasting.lag_features(_orders_daily(spark, sf)).select(
        "series", F.date_format("ts", "yyyy-MM-dd").alias("ts"),
        *[F.round(c, 2).alias(c) for c in ("y", "lag_1", "lag_7", "lag_14", "lag_21")], "day_of_week", "month",
    ),
    """WITH d AS (SELECT o_orderpriority AS series, date_trunc('day', o_orderdate)::DATE AS ts, ROUND(SUM(o_totalprice), 2) AS y FROM orders GROUP BY ALL),
l AS (SELECT *, LAG(y, 1) OVER w AS lag_1, LAG(y, 7) OVER w AS lag_7, LAG(y, 14) OVER w AS lag_14, LAG(y, 21) OVER w AS lag_21,
  (isodow(ts) - 1)::INTEGER AS day_of_week, MONTH(ts)::INTEGER AS month FROM d WINDOW w AS (PARTITION BY series ORDER BY ts))
SELECT * REPLACE (STRFTIME(ts, '%Y-%m-%d') AS ts) FROM l WHERE lag_21 IS NOT NULL""",
)
register("seasonal_trend_forecast", lambda spark, sf: forecasting.model_forecast(_orders_daily(spark, sf), "seasonal_trend"))
register("seasonal_ar_forecast", lambda spark, sf: forecasting.model_forecast(_orders_daily(spark, sf), "seasonal_ar"))
register("forecast_backtest", lambda spark, sf: forecasting.backtest(_orders_daily(spark, sf)))
register(
    "selected_forecast",
    lambda spark, sf: forecasting.forecast(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", ["o_orderpriority"]),
)
register("boosted_tree_forecast", lambda spark, sf: forecasting.tree_forecast(_events_daily(spark, sf), 30))


# ── what must hold for the models, as rows ──────────────────────────────────

_MODELS = ("seasonal_trend", "seasonal_ar")
register(
    "forecast_calendar",
    lambda spark, sf: forecasting.model_forecast(_orders_daily(spark, sf), _MODELS[0]).unionAll(
        forecasting.model_forecast(_orders_daily(spark, sf), _MODELS[1])
    ).select(
        "series", "model", F.date_format("ts", "yyyy-MM-dd").alias("ts"),
        ((F.col("lower") <= F.col("value")) & (F.col("value") <= F.col("upper"))).alias("in_band"),
    ),
    f"""SELECT o_orderpriority AS series, model, STRFTIME(MAX(o_orderdate)::DATE + k::INTEGER, '%Y-%m-%d') AS ts, TRUE AS in_band
FROM orders, (SELECT UNNEST({list(_MODELS)}) AS model), (SELECT UNNEST(range(1, 31)) AS k) GROUP BY o_orderpriority, model, k""",
)
register(
    "backtest_errors",
    lambda spark, sf: forecasting.backtest(_orders_daily(spark, sf)).select("series", "model", (F.col("mape") >= 0).alias("has_error")),
    f"SELECT DISTINCT o_orderpriority AS series, model, TRUE AS has_error FROM orders, (SELECT UNNEST({list(_MODELS)}) AS model)",
)


def _planted_series(spark, sf):
    """A value for every day from the first order to the last: a level per priority, a trend, and a wave over the week."""
    span = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    days = span.select("series", F.explode(F.sequence(F.col("a").cast("date"), F.col("b").cast("date"))).alias("day"))
    number, level = F.datediff("day", F.lit("1992-01-01").cast("date")), F.substring("series", 1, 1).cast("int") * 1000
    return days.select("series", "day", (level + 0.5 * number + 50 * F.sin(2 * 3.141592653589793 * F.dayofweek("day") / 7)).alias("y"))


def _planted_backtest(spark, sf):
    daily = forecasting.daily_series(_planted_series(spark, sf), "day", "y", ["series"])
    return forecasting.backtest(daily).select("series", "model", (F.col("mape") <= 0.02).alias("within_2_percent"))


register(
    "backtest_planted",
    _planted_backtest,
    f"SELECT DISTINCT o_orderpriority AS series, model, TRUE AS within_2_percent FROM orders, (SELECT UNNEST({list(_MODELS)}) AS model)",
)


def _bent_series(spark, sf):
    """The planted series with a slope that turns round on a day two thirds into them, and some noise by hash."""
    daily = forecasting.daily_series(_planted_series(spark, sf), "day", "y", ["series"])
    noise = (F.pmod(F.xxhash64("series", "ts"), F.lit(2001)) - 1000) / 1000 * 20
    return daily.withColumn("y", F.col("y") - 1.5 * F.greatest(F.datediff("ts", F.lit(_BEND).cast("date")), F.lit(0)) + noise)


_BEND = "1996-08-01"


def _changes_found(spark, sf):
    """Whether the planted change is found within a week, alone, with its slopes; and whether the bent line forecasts better than the straight one."""
    bent = _bent_series(spark, sf)
    changes = forecasting.trend_changes(bent).groupBy("series").agg(
        F.count("*").alias("changes"), F.max(F.abs(F.datediff("ts", F.lit(_BEND).cast("date"))) <= 7).alias("within_a_week"),
        F.max((F.abs(F.col("slope_before") - 0.5) < 0.05) & (F.abs(F.col("slope_after") + 1) < 0.05)).alias("slopes_close"),
    )
    errors = forecasting.backtest(bent, ["seasonal_trend", "straight_trend"]).groupBy("series").agg(
        (F.max(F.when(F.col("model") == "seasonal_trend", F.col("mape"))) < 0.5 * F.max(F.when(F.col("model") == "straight_trend", F.col("mape")))).alias("better")
    )
    return changes.join(errors, "series")


register(
    "trend_changes",
    _changes_found,
    "SELECT DISTINCT o_orderpriority AS series, 1 AS changes, TRUE AS within_a_week, TRUE AS slopes_close, TRUE AS better FROM orders",
)


def _planted(spark, sf):
    """Orders of which every 3,000th lies far off in both columns."""
    far = F.col("o_orderkey") % 3000 == 0
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(far, 1e9).otherwise(F.col("o_totalprice")).alias("price"), F.when(far, 1e9).otherwise(F.col("o_custkey")).alias("customer")
    )


register(
    "isolation_forest_planted",
    lambda spark, sf: forest.isolation_forest(_planted(spark, sf), ["o_orderkey"], ["price", "customer"], contamination=0.02).agg(
        F.count_if(F.col("o_orderkey") % 3000 == 0).alias("planted_found"),
        (F.count("*") <= F.lit(0.02 * table(spark, sf, "orders").count() + 1)).alias("within_share"),
    ),
    "SELECT COUNT(*) FILTER (WHERE o_orderkey % 3000 = 0) AS planted_found, TRUE AS within_share FROM orders",
)
register(
    "learned_checks",
    lambda spark, sf: learning.learn(
        table(spark, sf, "part"), "p_retailprice",
        {"p_size": "numeric_count", "p_brand": "categorical", "p_type": "categorical", "p_partkey": "numeric_count"},
        ["p_partkey"], trees=20,
    ).importances.agg(F.round(F.sum("importance"), 6).alias("total"), (F.min("importance") >= 0).alias("none_negative")),
    "SELECT 1.0 AS total, COUNT(*) > 0 AS none_negative FROM part",
)


def _labelled(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(
        "doc_id", "quality", "n_chars", "lang",
        F.size(F.split("text", r"\s+")).alias("n_words"),
        F.length(F.regexp_replace("text", r"[^.!?]", "")).alias("n_sentences"),
    )


LABEL_TYPES = {"n_chars": "numeric_count", "n_words": "numeric_count", "n_sentences": "numeric_count", "lang": "categorical"}
register(
    "engineered_features",
    lambda spark, sf: learning.engineer_features(
        table(spark, sf, "part").select(
            "p_partkey", F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size"), "p_retailprice",
            F.nullif("p_type", F.lit("SMALL")).alias("p_type"), F.lit(7).alias("n_same"),
        ),
        {"p_size": "numeric_count", "p_retailprice": "currency", "p_type": "categorical", "n_same": "numeric_count"},
        keep=["p_partkey"],
    ).data,
    """WITH m AS (SELECT MEDIAN(p_size) FILTER (WHERE p_size > 10) AS size FROM part),
k AS (SELECT p_type AS mode FROM part WHERE p_type <> 'SMALL' GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1),
f AS (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size ELSE size END::DOUBLE AS p_size, p_retailprice,
  COALESCE(NULLIF(p_type, 'SMALL'), mode) AS t FROM part, m, k)
SELECT p_partkey, p_size, p_retailprice, (t = 'LARGE')::INT::DOUBLE AS p_type_LARGE, (t = 'MEDIUM')::INT::DOUBLE AS p_type_MEDIUM,
  (t = 'PROMO')::INT::DOUBLE AS p_type_PROMO, (t = 'STANDARD')::INT::DOUBLE AS p_type_STANDARD FROM f""",
)
register("learned_summary", lambda spark, sf: learning.learn(_labelled(spark, sf), "quality", LABEL_TYPES, ["doc_id"]).summary)
register(
    "learned_importances",
    lambda spark, sf: learning.learn(
        table(spark, sf, "part"), "p_retailprice",
        {"p_size": "numeric_count", "p_brand": "categorical", "p_type": "categorical", "p_partkey": "numeric_count"},
        ["p_partkey"], trees=100,
    ).importances,
)
register(
    "best_model_runs",
    lambda spark, sf: operations.best_runs(
        table(spark, sf, "events").select(
            F.col("event_id").cast("string").alias("run_id"), F.col("event_type").alias("target"), F.col("value").alias("score")
        )
    ),
    """SELECT run_id, target, score FROM (SELECT event_id::VARCHAR AS run_id, event_type AS target, value AS score,
  ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY value DESC, event_id::VARCHAR DESC) AS r FROM events) WHERE r = 1""",
)
