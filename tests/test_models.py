import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.operators import forecasting, learning


@pytest.fixture(scope="module")
def series(spark):
    """Two series with trend and weekly wave, one too short."""
    rows = []
    for name, slope, days in (("up", 2.0, 120), ("down", -1.0, 120), ("short", 1.0, 6)):
        for i in range(days):
            rows.append((name, i, 500 + slope * i + 30 * float(np.sin(2 * np.pi * i / 7))))
    df = spark.createDataFrame(rows, "series string, i int, y double")
    return df.select("series", F.expr("date_add(date'2024-01-01', i)").alias("ts"), "y")


@pytest.mark.parametrize("model", ["seasonal_trend", "seasonal_ar"])
def test_models_follow_trend_and_wave(series, model):
    rows = forecasting.model_forecast(series, model, 14).orderBy("series", "ts").collect()
    assert {r.series for r in rows} == {"up", "down"} and len(rows) == 28
    up = [r for r in rows if r.series == "up"]
    want = [500 + 2.0 * i + 30 * np.sin(2 * np.pi * i / 7) for i in range(120, 134)]
    assert np.mean([abs(r.value - w) / w for r, w in zip(up, want)]) < 0.05
    assert up[0].trend_direction == "up" and all(r.lower <= r.value <= r.upper for r in rows)
    assert str(up[0].ts) == "2024-04-30"


def test_choice_by_error(spark):
    scores = spark.createDataFrame(
        [("a", "seasonal_trend", 0.3), ("a", "seasonal_ar", 0.2), ("b", "seasonal_ar", None), ("b", "seasonal_trend", None)],
        "series string, model string, mape double",
    )
    got = {r.series: r.model for r in forecasting.best_models(scores).collect()}
    assert got == {"a": "seasonal_ar", "b": "seasonal_trend"}


def test_boosted_trees(series):
    rows = forecasting.tree_forecast(series, horizon=12, max_iter=5).collect()
    assert {r.series for r in rows} == {"up", "down"} and len(rows) == 24
    assert all(r.lower <= r.value <= r.upper for r in rows)


def test_backtest(series):
    scores = forecasting.backtest(series, horizon=10).collect()
    assert len(scores) == 4 and all(r.mape < 0.2 for r in scores)


def test_classification_and_regression(spark):
    df = spark.range(400).select(
        "id", (F.col("id") % 10).cast("double").alias("amount"),
        F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").alias("kind"),
        F.lit(1.0).alias("same"), ((F.col("id") % 10) > 4).cast("int").alias("label"),
        ((F.col("id") % 10) * 2.5).alias("score"),
    )
    types = {"amount": "currency", "kind": "categorical", "same": "numeric_measure"}
    features = learning.engineer_features(df, types, keep=["id"])
    assert features.names == ["amount", "kind_y"]
    hit = learning.learn(df.drop("score"), "label", types, ["id"], trees=10)
    row = hit.summary.first()
    assert row.task == "classification" and row.cv_score_mean > 0.95 and hit.importances.first().feature == "amount"
    fit = learning.learn(df.drop("label"), "score", types, ["id"], trees=10)
    assert fit.summary.first().task == "regression" and fit.summary.first().cv_score_mean > 0.9


def test_viability_and_fallback(spark, monkeypatch):
    from siftstone.operators import profiling

    days = spark.range(60).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), (100 + F.col("id") % 7 + F.col("id") / 2).alias("sales_amount"))
    profile = profiling.types_of(profiling.profile_table(days).columns)
    assert profile["day"] == "date"
    found, reason = forecasting.viable_forecast(days, profiling.profile_table(days).columns)
    assert found.count() == 30 and reason == "Forecasting conditions met"
    flat = days.select("sales_amount")
    none, reason = forecasting.viable_forecast(flat, profiling.profile_table(flat).columns)
    assert none.count() == 0 and reason == "No datetime columns detected"
    monkeypatch.setattr(forecasting, "_predict", lambda *a: None)
    fallen = forecasting.forecast(days, "day", "sales_amount", horizon=3)
    assert {r.model for r in fallen.collect()} == {"boosted_trees"} and fallen.count() == 3


def test_likelihood_of_shapes():
    """Newton's answers are where the likelihood is greatest."""
    import math

    import numpy as np

    from siftstone.functions import distributions as dist

    assert abs(dist.digamma(1.0) + 0.5772156649015329) < 1e-12 and abs(dist.trigamma(1.0) - math.pi**2 / 6) < 1e-10
    random = np.random.default_rng(4)
    x = random.gamma(2.5, 3.0, 5000)
    a = dist.gamma_shape(x.mean(), np.log(x).mean())
    like = lambda a: (a - 1) * np.log(x).mean() - a - math.lgamma(a) - a * math.log(x.mean() / a)
    assert abs(a - 2.5) < 0.1 and all(like(a) >= like(a + d) for d in (-0.01, 0.01))
    y = random.beta(0.7, 4.0, 5000)
    p, q = dist.beta_shapes(np.log(y).mean(), np.log1p(-y).mean(), 1.0, 1.0)
    of = lambda p, q: (p - 1) * np.log(y).mean() + (q - 1) * np.log1p(-y).mean() - math.lgamma(p) - math.lgamma(q) + math.lgamma(p + q)
    assert abs(p - 0.7) < 0.05 and all(of(p, q) >= of(p + d, q + e) for d in (-0.01, 0.01) for e in (-0.02, 0.02))
    assert dist.gamma_shape(3.0, math.log(3.0)) is None


def test_trend_changes_of_one_series():
    import numpy as np

    from siftstone.operators import forecasting

    random, days = np.random.default_rng(2), np.arange(9000.0, 9600.0)
    wave = 8 * np.sin(2 * np.pi * days / 7)
    straight = 100 + 0.3 * (days - 9000) + wave + random.normal(0, 3, len(days))
    assert len(forecasting._trend_fit(days, straight)[2]) == 0
    bent = straight - 0.9 * np.maximum(days - 9210, 0) + 1.5 * np.maximum(days - 9430, 0)
    changes = forecasting._trend_fit(days, bent)[2]
    assert len(changes) == 2 and abs(changes[0] - 9210) <= 7 and abs(changes[1] - 9430) <= 7
    ahead = np.arange(9600.0, 9630.0)
    truth = 100 + 0.3 * (ahead - 9000) - 0.9 * (ahead - 9210) + 1.5 * (ahead - 9430) + 8 * np.sin(2 * np.pi * ahead / 7)
    errors = [np.abs(forecasting._trend_model(days, bent, ahead, changing)[0] - truth).mean() for changing in (True, False)]
    assert errors[0] < 5 and errors[0] < 0.3 * errors[1]
    for y in (np.zeros(600), random.normal(0, 1, 600), np.arange(600.0)):
        assert len(forecasting._trend_fit(days, y)[2]) == 0
    assert len(forecasting._trend_fit(days[:20], bent[:20])[2]) == 0
