"""Forecasts of many series at once: every series is daily totals by the time a model sees it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ref
from ..session import cut_lineage
from .profiling import forecast_candidates
from .relations import mape
from .timeseries import period_totals

LAGS = [1, 7, 14, 21]
MIN_POINTS = 10
MIN_TREE_POINTS = 26
PRIORITY = {"seasonal_trend": 0, "seasonal_ar": 1, "boosted_trees": 2}
FORECAST = "series string, model string, ts date, value double, lower double, upper double, trend_direction string"


def daily_series(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), func: str = "SUM") -> DataFrame:
    """``series, ts, y``: one row per series and day, a few thousand per series at most."""
    key = F.concat_ws("|", *[F.coalesce(ref(c).cast("string"), F.lit("")) for c in by]) if by else F.lit("all")
    return period_totals(df, ts, value, "day", func, by).select(
        key.alias("series"), F.col("period").cast("date").alias("ts"), F.col("period_value").alias("y")
    )


# ── models on one series (numpy) ────────────────────────────────────────────


def _season(days: np.ndarray, period: float, order: int) -> np.ndarray:
    angle = 2 * np.pi * np.outer(days / period, np.arange(1, order + 1))
    return np.hstack([np.sin(angle), np.cos(angle)])


#: Changes of trend are looked for at up to so many places, evenly over the first part of a series.
CHANGE_PLACES, CHANGE_RANGE = 120, 0.9
#: Fewest days for changes to be looked for, and most of them in one series.
CHANGE_DAYS, MOST_CHANGES = 60, 10


def _lasso(gram: np.ndarray, target: np.ndarray, penalty: float, start: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Coordinate descent for ``b'Gb / 2 - t'b + penalty * |b|``."""
    b, pull = start.copy(), gram @ start
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero((b != 0) | (np.abs(target - pull) > penalty)):
            if gram[j, j] <= 1e-12:
                continue
            free = target[j] - pull[j] + gram[j, j] * b[j]
            new = np.sign(free) * max(abs(free) - penalty, 0.0) / gram[j, j]
            if new != b[j]:
                pull += gram[:, j] * (new - b[j])
                moved, b[j] = max(moved, abs(new - b[j]) * np.sqrt(gram[j, j])), new
        if moved < 1e-9 * (1 + np.abs(b).max()):
            break
    return b


def _hinges(days: np.ndarray, changes: np.ndarray, span: float) -> np.ndarray:
    return np.maximum(days[:, None] - np.asarray(changes, float)[None, :], 0.0) / span


def _trend_changes(days: np.ndarray, y: np.ndarray, x: np.ndarray, span: float) -> np.ndarray:
    """Days on which the slope changes; none where a straight line does (by the Bayesian criterion).

    Slopes may change at many places, and the sum of the changes' sizes is penalised. Along the penalty's path neighbouring places count as one
    change; of the sets found, each moved to where it fits best, the one with the best criterion stays.
    """
    n = len(days)
    if n < CHANGE_DAYS or np.ptp(y) == 0:
        return np.zeros(0)
    places = np.linspace(days[0], days[0] + CHANGE_RANGE * span, min(CHANGE_PLACES, n // 4) + 2)[1:-1]
    basis, _ = np.linalg.qr(x)
    rest = lambda m: m - basis @ (basis.T @ m)
    bends, residual = rest(_hinges(days, places, span)), rest(y)
    size = np.sqrt((bends**2).sum(axis=0))
    bends = bends / np.where(size < 1e-12, 1.0, size)
    gram, target = bends.T @ bends, bends.T @ residual

    def criterion(changes):
        bent = rest(_hinges(days, changes, span)) if len(changes) else np.zeros((n, 0))
        left = residual - bent @ np.linalg.lstsq(bent, residual, rcond=None)[0] if len(changes) else residual
        # a change costs its place and its size
        return n * np.log(max(float(left @ left) / n, 1e-18)) + 2 * len(changes) * np.log(n)

    best, score, b = np.zeros(0), criterion(np.zeros(0)), np.zeros(len(places))
    seen = set()
    for penalty in np.abs(target).max() * np.geomspace(0.9, 0.01, 14):
        b = _lasso(gram, target, penalty, b)
        active = np.flatnonzero(b)
        groups = np.split(active, np.flatnonzero(np.diff(active) > 2) + 1) if len(active) else []
        if not groups or len(groups) > MOST_CHANGES:
            continue
        changes = np.array([np.average(places[g], weights=np.abs(b[g])) for g in groups])
        key = tuple(np.round(changes))
        if key in seen:
            continue
        seen.add(key)
        step = places[1] - places[0] if len(places) > 1 else 1.0
        while step >= 0.5:  # each change moves while that fits better
            for k in range(len(changes)):
                tries = [np.concatenate((changes[:k], [changes[k] + d], changes[k + 1 :])) for d in (-step, 0.0, step)]
                changes = min(tries, key=criterion)
            step /= 2
        while len(changes):  # and goes where it is not worth its cost
            fewer = min((np.delete(changes, k) for k in range(len(changes))), key=criterion)
            if criterion(fewer) > criterion(changes):
                break
            changes = fewer
        if criterion(changes) < score - 1e-9:
            best, score = changes, criterion(changes)
    return np.sort(best)


def _trend_fit(days: np.ndarray, y: np.ndarray, changing: bool = True):
    """Ridge regression on a line that may bend, a yearly and a weekly wave: the design of any days, coefficients, days of the bends."""
    origin, span = days[0], max(days[-1] - days[0], 1.0)

    def straight(d):
        line = np.column_stack([np.ones(len(d)), (d - origin) / span])
        # a yearly wave needs two years to be told from a trend
        return np.hstack([line, _season(d, 7.0, 3), _season(d, 365.25, 5 if span >= 2 * 365 else 0)])

    changes = _trend_changes(days, y, straight(days), span) if changing else np.zeros(0)
    design = lambda d: np.hstack([straight(d), _hinges(d, changes, span)])
    x = design(days)
    penalty = np.full(x.shape[1], 1.0)
    penalty[:2] = 1e-8
    penalty[x.shape[1] - len(changes) :] = 1e-8
    beta = np.linalg.solve(x.T @ x + np.diag(penalty), x.T @ y)
    return design, beta, changes


def _trend_model(days: np.ndarray, y: np.ndarray, future: np.ndarray, changing: bool = True):
    """The bending line and the waves, carried on."""
    design, beta, changes = _trend_fit(days, y, changing)
    spread = float(np.std(y - design(days) @ beta))
    ahead = design(future)
    parts = [0, 1, *range(len(beta) - len(changes), len(beta))]
    line = ahead[:, parts] @ beta[parts]
    value = ahead @ beta
    band = 1.96 * spread * np.ones(len(future))
    return value, band, float(line[-1] - line[0])


def _ar_model(y: np.ndarray, steps: int, season: int = 7):
    """Autoregression with a weekly lag; order and differencing by AIC."""
    best = None
    for d in (0, 1):
        z = np.diff(y) if d else y
        for p in range(1, 6):
            lags = list(range(1, p + 1)) + ([season] if len(z) > 3 * season else [])
            depth = max(lags)
            n = len(z) - depth
            if n < len(lags) + 3:
                continue
            x = np.column_stack([np.ones(n)] + [z[depth - k : len(z) - k] for k in lags])
            beta, *_ = np.linalg.lstsq(x, z[depth:], rcond=None)
            residual = z[depth:] - x @ beta
            variance = max(float(residual @ residual) / n, 1e-12)
            # per observation, so that samples of different length compare
            score = np.log(variance) + 2 * (x.shape[1] + d) / n
            if best is None or score < best[0]:
                best = (score, d, lags, beta, variance)
    if best is None:
        return None
    _, d, lags, beta, variance = best
    history = list(np.diff(y) if d else y)
    psi, level, values = [1.0], y[-1], []
    for step in range(steps):
        nxt = beta[0] + sum(b * history[-k] for b, k in zip(beta[1:], lags))
        history.append(nxt)
        level = level + nxt if d else nxt
        values.append(level)
        psi.append(sum(b * psi[step + 1 - k] for b, k in zip(beta[1:], lags) if step + 1 - k >= 0))
    weights = np.cumsum(psi[:steps]) if d else np.array(psi[:steps])
    band = 1.96 * np.sqrt(variance * np.cumsum(weights**2))
    return np.array(values), band, float(values[-1] - values[0])


def _predict(model: str, part: pd.DataFrame, horizon: int) -> pd.DataFrame | None:
    part = part.sort_values("ts")
    dates = pd.to_datetime(part["ts"])
    y = part["y"].to_numpy(dtype=float)
    if len(y) < MIN_POINTS:
        return None
    future = pd.date_range(dates.iloc[-1] + pd.Timedelta(days=1), periods=horizon, freq="D")
    if model in ("seasonal_trend", "straight_trend"):
        days = lambda d: (d - pd.Timestamp("1970-01-01")).days.to_numpy(dtype=float)
        found = _trend_model(days(pd.DatetimeIndex(dates)), y, days(future), model == "seasonal_trend")
    else:
        found = _ar_model(y, horizon)
    if found is None:
        return None
    value, band, drift = found
    return pd.DataFrame(
        {
            "series": part["series"].iloc[0], "model": model, "ts": future.date, "value": np.round(value, 4),
            "lower": np.round(value - band, 4), "upper": np.round(value + band, 4),
            "trend_direction": "up" if drift > 0 else "down" if drift < 0 else "flat",
        }
    )


def model_forecast(series: DataFrame, model: str, horizon: int = 30) -> DataFrame:
    """30 days ahead with a 95 % band, each series fitted in its own task; under ten points no rows.

    ``seasonal_trend`` has a line that may bend, ``straight_trend`` one that does not; ``seasonal_ar`` is an autoregression.
    """
    if model not in ("seasonal_trend", "straight_trend", "seasonal_ar"):
        raise ValueError(f"unknown model: {model!r}")
    names = [f.split()[0] for f in FORECAST.split(", ")]

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        found = _predict(model, part, horizon)
        return found if found is not None else pd.DataFrame({n: pd.Series(dtype=object) for n in names})

    return series.groupBy("series").applyInPandas(fit, FORECAST)


def trend_changes(series: DataFrame) -> DataFrame:
    """``series, ts, slope_before, slope_after``: where the trend of each series changes, and its slope a day on either side."""

    def find(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ts")
        days = (pd.DatetimeIndex(pd.to_datetime(part["ts"])) - pd.Timestamp("1970-01-01")).days.to_numpy(dtype=float)
        _, beta, changes = _trend_fit(days, part["y"].to_numpy(dtype=float)) if len(part) >= MIN_POINTS else (None, np.zeros(2), np.zeros(0))
        slopes = np.cumsum(np.concatenate(([beta[1]], beta[len(beta) - len(changes) :]))) / max(days[-1] - days[0], 1.0)
        return pd.DataFrame({
            "series": [part["series"].iloc[0]] * len(changes), "ts": (pd.Timestamp("1970-01-01") + pd.to_timedelta(np.round(changes), unit="D")).date,
            "slope_before": slopes[:-1], "slope_after": slopes[1:],
        })

    return series.groupBy("series").applyInPandas(find, "series string, ts date, slope_before double, slope_after double")


# ── boosted trees over lags ─────────────────────────────────────────────────


def lag_features(series: DataFrame) -> DataFrame:
    """Lags 1, 7, 14, 21, weekday (Monday 0) and month; rows without all lags are left out."""
    order = Window.partitionBy("series").orderBy("ts")
    out = series.withColumns({f"lag_{k}": F.lag("y", k).over(order) for k in LAGS})
    return out.withColumns({"day_of_week": F.weekday("ts"), "month": F.month("ts")}).dropna(
        subset=[f"lag_{k}" for k in LAGS]
    )


FEATURES = [f"lag_{k}" for k in LAGS] + ["day_of_week", "month"]


def fit_trees(series: DataFrame, max_iter: int = 100):
    """One boosted model pooled over all series (MLlib, distributed)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(lag_features(series))
    return GBTRegressor(
        labelCol="y", featuresCol="features", maxIter=max_iter, maxDepth=4, stepSize=0.1, seed=42
    ).fit(data.select("features", "y"))


def tree_forecast(series: DataFrame, horizon: int = 30, max_iter: int = 100, model=None) -> DataFrame:
    """Recursive rollout: each step predicts one day for all series and feeds it back.

    The state is one row per series with its last 21 values, so a step is a
    projection without a shuffle; lineage is cut every ten steps.
    """
    from pyspark.ml.feature import VectorAssembler

    counted = Window.partitionBy("series")
    enough = series.withColumn("_n", F.count("*").over(counted)).where(F.col("_n") >= MIN_TREE_POINTS).drop("_n")
    model = model or fit_trees(enough, max_iter)
    recent = Window.partitionBy("series").orderBy(F.desc("ts"))
    state = (
        enough.withColumn("_r", F.row_number().over(recent))
        .where(F.col("_r") <= max(LAGS))
        .groupBy("series")
        .agg(F.sort_array(F.collect_list(F.struct("ts", "y"))).alias("h"), F.max("ts").alias("last"))
        .select("series", "last", F.col("h.y").alias("h"), F.array().cast("array<double>").alias("out"))
    )
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    for step in range(1, horizon + 1):
        day = F.date_add("last", step)
        lagged = state.withColumns(
            {f"lag_{k}": F.get("h", F.lit(max(LAGS) - k)) for k in LAGS}
        ).withColumns({"day_of_week": F.weekday(day), "month": F.month(day)})
        predicted = model.transform(assemble.transform(lagged))
        state = predicted.select(
            "series", "last",
            F.concat(F.slice("h", 2, max(LAGS) - 1), F.array("prediction")).alias("h"),
            F.concat("out", F.array("prediction")).alias("out"),
        )
        if step % 10 == 0 and step < horizon:
            state = cut_lineage(state)
    first, last = F.get("out", F.lit(0)), F.get("out", F.lit(horizon - 1))
    value = F.round("v", 4)
    return state.select(
        "series", "last", F.posexplode("out").alias("i", "v"),
        F.when(last > first, "up").when(last < first, "down").otherwise("flat").alias("trend_direction"),
    ).select(
        "series", F.lit("boosted_trees").alias("model"), F.expr("date_add(last, i + 1)").alias("ts"),
        value.alias("value"), F.round(F.col("v") * 0.9, 4).alias("lower"), F.round(F.col("v") * 1.1, 4).alias("upper"),
        "trend_direction",
    )


def feature_importances(spark, model, names: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    values = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, values)), "feature string, importance double")


# ── backtest and choice ─────────────────────────────────────────────────────


def backtest(series: DataFrame, models: Sequence[str] = ("seasonal_trend", "seasonal_ar"), horizon: int = 30) -> DataFrame:
    """``series, model, mape`` on the last days of each series (a fifth of it, at most the horizon)."""
    order = Window.partitionBy("series").orderBy("ts")
    whole = Window.partitionBy("series")
    numbered = series.withColumns({"_i": F.row_number().over(order), "_n": F.count("*").over(whole)})
    held = F.least(F.lit(horizon), F.floor(F.col("_n") / 5))
    train = numbered.where(F.col("_i") <= F.col("_n") - held).select("series", "ts", "y")
    test = numbered.where(F.col("_i") > F.col("_n") - held).select("series", "ts", "y")
    predicted = None
    for model in models:
        part = tree_forecast(train, horizon) if model == "boosted_trees" else model_forecast(train, model, horizon)
        part = part.select("series", "model", "ts", "value")
        predicted = part if predicted is None else predicted.unionAll(part)
    return mape(test.join(predicted, ["series", "ts"]), "y", "value", ["series", "model"])


def best_models(results: DataFrame) -> DataFrame:
    """Lowest error first, then model priority; a model without an error comes last."""
    rank = F.lit(99)
    for name, place in PRIORITY.items():
        rank = F.when(F.col("model") == name, place).otherwise(rank)
    order = Window.partitionBy("series").orderBy(F.col("mape").asc_nulls_last(), rank, "model")
    return results.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).drop("_r")


def forecast(
    df: DataFrame,
    ts: str,
    value: str,
    by: Sequence[str] = (),
    horizon: int = 30,
    func: str = "SUM",
    models: Sequence[str] = ("seasonal_trend", "seasonal_ar"),
) -> DataFrame:
    """The best model's forecast for every series: ``series, model, ts, value, lower, upper, mape``.

    A series for which none of the models gives a forecast falls back to boosted trees, if it is long enough for them. The daily totals are written once, as every model and the backtest read them.
    """
    series = cut_lineage(daily_series(df, ts, value, by, func))
    every = None
    for model in models:
        part = tree_forecast(series, horizon) if model == "boosted_trees" else model_forecast(series, model, horizon)
        every = part if every is None else every.unionAll(part)
    left = series.join(every.select("series").distinct(), "series", "left_anti")
    left = left.join(left.groupBy("series").agg(F.count("*").alias("_n")).where(F.col("_n") >= MIN_TREE_POINTS).select("series"), "series", "left_semi")
    if "boosted_trees" not in models and not left.isEmpty():
        every = every.unionAll(tree_forecast(left, horizon))
    scores = backtest(series, models, horizon)
    offered = every.select("series", "model").distinct().join(scores, ["series", "model"], "left")
    return every.join(best_models(offered), ["series", "model"])


def viable_forecast(df: DataFrame, columns: DataFrame, horizon: int = 30) -> tuple[DataFrame, str]:
    """The forecast of the first target over the first date column of a profiled table, and the verdict.

    ``columns`` are profile rows with semantic types. Where the table is no candidate, there are no rows and the verdict tells why.
    """
    found = forecast_candidates(columns).first()
    if not found.viable:
        return df.sparkSession.createDataFrame([], FORECAST + ", mape double"), found.reason
    return forecast(df, found.date_columns[0], found.target_columns[0], horizon=horizon), found.reason
