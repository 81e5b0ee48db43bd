"""Baseline models: feature matrix, random forest with cross-validation, importances."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import number, numeric_columns, ref
from ..session import SPREAD_ROWS
from .quantiles import column_quantiles
from .statistics import distinct_counts, top_value_counts

MEASURES = ("currency", "numeric_measure", "numeric_count", "percentage")


@dataclass(frozen=True)
class Features:
    """The rows with one double column per feature, and the names of the features."""

    data: DataFrame
    names: list[str]


def engineer_features(
    df: DataFrame, types: Mapping[str, str], keep: Sequence[str] = (), max_categories: int = 10
) -> Features:
    """Measures with median fill, small categories as 0/1 columns without the first value.

    Constant features are dropped. Without typed columns all numeric ones are
    used. Medians and category lists (at most ten values per column) are the
    only numbers read by the driver.
    """
    usable = [c for c in df.columns if c not in keep]
    measures = [c for c in usable if types.get(c) in MEASURES]
    categories = [c for c in usable if types.get(c) == "categorical"]
    fill: dict[str, float] = {}
    if not measures and not categories:
        measures = [c for c in numeric_columns(df) if c not in keep]
        fill = dict.fromkeys(measures, 0.0)
    elif measures:
        fill = {r.column_name: r.q[0] for r in column_quantiles(df, measures, [0.5]).collect()}
    checked = measures + categories
    distinct = (
        {r.column_name: r.unique_count for r in distinct_counts(df, checked).collect()} if checked else {}
    )
    missing = df.agg(*[F.count_if(ref(c).isNull()).alias(c) for c in checked]).first() if checked else {}
    columns = {}
    for c in measures:
        # one value and no gap, or a gap filled with that same value: constant
        if distinct[c] > 1 or (missing[c] and distinct[c] == 1 and fill.get(c) == 0.0):
            columns[c] = F.coalesce(number(df, c), F.lit(float(fill.get(c, 0.0))))
    small = [c for c in categories if 0 < distinct[c] <= max_categories]
    if small:
        values: dict[str, list] = {c: [] for c in small}
        for r in top_value_counts(df, small, max_categories).orderBy("column_name", "rank").collect():
            values[r.column_name].append(r.value)
        for c in small:
            mode = values[c][0]
            filled = F.coalesce(ref(c).cast("string"), F.lit(mode))
            for v in sorted(values[c])[1:]:
                columns[f"{c}_{v}"] = F.when(filled == v, 1.0).otherwise(0.0)
    data = df.select(*[ref(c) for c in keep], *[e.alias(n) for n, e in columns.items()])
    return Features(data, list(columns))


def _dealt(data: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows beyond one task's share dealt out by key, in a fixed order, as the bagging follows it.

    Every task hands on its statistics of all nodes of the trees, so there are no more tasks than a few per core.
    """
    tasks = min(math.ceil(data.count() / SPREAD_ROWS), 2 * data.sparkSession.sparkContext.defaultParallelism)
    return data.repartition(tasks, *[ref(k) for k in key]).sortWithinPartitions(*[ref(c) for c in data.columns]) if tasks > 1 else data


@dataclass(frozen=True)
class Learned:
    """One-row summary, the ten most important features, the fitted model."""

    summary: DataFrame
    importances: DataFrame
    model: object


def learn(
    df: DataFrame,
    target: str,
    types: Mapping[str, str],
    key: Sequence[str],
    folds: int = 3,
    trees: int = 100,
    max_depth: int = 8,
    seed: int = 42,
) -> Learned:
    """Random forest with cross-validation on all rows.

    Up to 20 distinct integer or text targets make it a classification
    (accuracy), else a regression (R²). Folds follow a hash of the key, so they
    are the same in every run. Missing targets count as 0.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor
    from pyspark.ml.tuning import CrossValidator

    spark = df.sparkSession
    dtype = df.schema[target].dataType
    discrete = isinstance(dtype, (T.IntegralType, T.StringType, T.BooleanType))
    kinds = distinct_counts(df, [target]).first().unique_count
    classify = discrete and kinds <= 20
    features = engineer_features(df, types, keep=[*key, target])
    if not features.names:
        raise ValueError("no usable features")
    data = _dealt(features.data, key)
    if classify:
        text = F.coalesce(ref(target).cast("string"), F.lit("0"))
        classes = sorted(r[0] for r in data.select(text).distinct().collect())  # at most 21 values
        label = F.lit(0.0)
        for i, value in enumerate(classes):
            label = F.when(text == value, float(i)).otherwise(label)
        estimator = RandomForestClassifier(numTrees=trees, maxDepth=max_depth, seed=seed, labelCol="label")
        judge, scoring = MulticlassClassificationEvaluator(metricName="accuracy", labelCol="label"), "accuracy"
    else:
        label = F.coalesce(number(data, target), F.lit(0.0))
        estimator = RandomForestRegressor(
            numTrees=trees, maxDepth=max_depth, seed=seed, labelCol="label", featureSubsetStrategy="all"
        )
        judge, scoring = RegressionEvaluator(metricName="r2", labelCol="label"), "r2"
    fold = F.pmod(F.xxhash64(*[ref(k) for k in key], F.lit(seed)), F.lit(folds)).cast("int")
    vectors = VectorAssembler(inputCols=[f"`{n}`" if "." in n else n for n in features.names], outputCol="features")
    train = vectors.transform(data.withColumns({"label": label, "fold": fold})).select("features", "label", "fold")
    train = train.persist()
    try:
        rows = train.count()
        fitted = CrossValidator(
            estimator=estimator, estimatorParamMaps=[{}], evaluator=judge, numFolds=folds, foldCol="fold", seed=seed
        ).fit(train)
    finally:
        train.unpersist()
    model = fitted.bestModel
    ranked = sorted(zip(features.names, model.featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))[:10]
    importances = spark.createDataFrame(
        [(i + 1, n, float(v)) for i, (n, v) in enumerate(ranked)], "rank int, feature string, importance double"
    )
    summary = spark.createDataFrame(
        [("classification" if classify else "regression", target, "RandomForest", len(features.names),
          round(float(fitted.avgMetrics[0]), 4), round(float(fitted.stdMetrics[0]), 4), scoring, rows)],
        "task string, target string, model_type string, feature_count int, cv_score_mean double, "
        "cv_score_std double, scoring string, training_rows long",
    )
    return Learned(summary, importances, model)


def run_rows(learned: Learned, run_id: str) -> DataFrame:
    """A row for the table of model runs (see ``operations.best_runs``)."""
    return learned.summary.select(
        F.lit(run_id).alias("run_id"), "target", "model_type", F.col("cv_score_mean").alias("score"), "scoring",
        F.current_timestamp().alias("finished_at"),
    )
