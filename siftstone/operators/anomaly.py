"""Anomaly detection: z-score and fence methods, domain rules, routing and ranking.

Every detector is a stats pass (one row per column, read as numbers) followed by
one filtered scan: the bounds become literals, so they are pushed to the scan and
rows inside the bounds are dropped before anything else is computed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import fixed_point, kind_of, number, ref, severity_rank
from .quantiles import column_quantiles
from .statistics import value_ranges

# Plausible years and the e-mail shape of the domain rules.
YEARS = (1900, 2100)
EMAIL_SHAPE = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
NUMERIC_TYPES = ("currency", "numeric_measure", "numeric_count", "percentage")

CANDIDATE = (
    "column string, detection_method string, anomaly_type string, severity string, "
    "confidence double, rows_affected int, value string, score double, description string"
)


@dataclass(frozen=True)
class Facts:
    """Column-level numbers the bounds are made of."""

    n: int
    mean: float | None
    stddev: float | None
    low: float | None
    high: float | None
    q1: float | None
    median: float | None
    q3: float | None


def column_facts(df: DataFrame, columns: Sequence[str], stddev: str = "pop", approx: bool = False) -> dict[str, Facts]:
    """Moments and quartiles of the columns, one row per column read by the driver."""
    if not columns:
        return {}
    base = {r.column_name: r for r in value_ranges(df, columns).collect()}
    rows = max(r.total_rows for r in base.values())
    quartiles = {
        r.column_name: r.q for r in column_quantiles(df, columns, [0.25, 0.5, 0.75], approx, rows).collect()
    }
    return {
        c: Facts(
            base[c].non_null_count, base[c].mean, base[c][f"stddev_{stddev}"],
            base[c].min_val, base[c].max_val, *quartiles.get(c, (None, None, None)),
        )
        for c in columns
    }


def _absolute_deviation(df: DataFrame, facts: Mapping[str, Facts]) -> dict[str, float | None]:
    """Median absolute deviation per column, again one row per column."""
    columns = [c for c, f in facts.items() if f.median is not None]
    if not columns:
        return {}
    spread = df.select(
        *[F.abs(number(df, c) - F.lit(facts[c].median)).alias(c) for c in columns]
    )
    return {
        r.column_name: (r.q[0] if r.q else None) for r in column_quantiles(spread, columns, [0.5]).collect()
    }


def _flagged(df: DataFrame, key: Sequence[str], items: Sequence[tuple[Column, Sequence[Column]]]) -> DataFrame:
    """One scan for many detectors: rows that fail no test are dropped first."""
    anything = reduce(lambda a, b: a | b, [condition for condition, _ in items])
    hits = F.array_compact(F.array(*[F.when(c, F.struct(*fields)) for c, fields in items]))
    return df.where(anything).select(*[ref(k) for k in key], F.inline(hits))


# ── two-method candidates ───────────────────────────────────────────────────


def two_method_candidates(
    df: DataFrame,
    key: Sequence[str],
    columns: Sequence[str] | str,
    z_threshold: float = 3.0,
    iqr_multiplier: float = 1.5,
    limit: int | None = None,
    stddev: str = "pop",
) -> DataFrame:
    """Rows outside the z-score bound or the Tukey fence, with severity and confidence.

    ``limit`` keeps the strongest rows of each column (None: all of them).
    ``stddev='samp'`` divides by the sample deviation.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    facts = column_facts(df, columns, stddev)
    items = []
    for c in columns:
        f = facts[c]
        if f.n == 0:
            continue
        value = number(df, c)
        iqr = f.q3 - f.q1
        low, high = f.q1 - iqr_multiplier * iqr, f.q3 + iqr_multiplier * iqr
        outside = (value < F.lit(low)) | (value > F.lit(high))
        if f.stddev:
            z = (value - F.lit(f.mean)) / F.lit(f.stddev)
            far = F.abs(z) >= z_threshold
        else:
            z, far = F.lit(None).cast("double"), F.lit(False)
        numbers = {
            "value": value, "z": z, "is_iqr_outlier": outside, "is_zscore_outlier": far,
            "fence_distance": F.greatest(F.lit(low) - value, value - F.lit(high), F.lit(0.0)),
            "iqr_direction": F.when(value < F.lit(low), "low").when(value > F.lit(high), "high").otherwise("normal"),
        }
        context = {
            "col_mean": f.mean, "col_stddev": f.stddev, "q1": f.q1, "q3": f.q3, "iqr": iqr,
            "lower_fence": low, "upper_fence": high,
        }
        items.append(
            (
                outside | far,
                [
                    F.lit(c).alias("column_name"),
                    *[e.alias(n) for n, e in numbers.items()],
                    *[F.lit(v).cast("double").alias(n) for n, v in context.items()],
                    F.lit(f.n).alias("non_null_count"),
                ],
            )
        )
    if not items:
        raise ValueError("no numeric values in the given columns")
    hits = _flagged(df, key, items)
    size = F.abs("z")
    both = F.col("is_iqr_outlier") & F.col("is_zscore_outlier")
    severity = (
        F.when(both & (size >= 5), "critical")
        .when(both, "high")
        .when(size >= 4, "high")
        .when(F.col("is_zscore_outlier"), "medium")
        .otherwise("low")
    )
    share = F.when(both, 1.0).when(F.col("is_iqr_outlier"), 0.6).otherwise(0.3)
    confidence = F.least(F.lit(1.0), 0.5 * F.least(size / 6.0, F.lit(1.0)) + 0.5 * share)
    scored = hits.withColumns({"severity": severity, "abs_z": size, "_confidence": confidence, "_both": both})
    if limit is not None:
        order = Window.partitionBy("column_name").orderBy(
            severity_rank(F.col("severity")), F.desc("abs_z"), *[ref(k) for k in key]
        )
        scored = scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit)
    fence = F.concat(
        F.lit("["), fixed_point(F.col("lower_fence")), F.lit(", "), fixed_point(F.col("upper_fence")), F.lit("]")
    )
    shown, sigmas, mean = fixed_point(F.col("value")), fixed_point(F.col("abs_z"), 1), fixed_point(F.col("col_mean"))
    description = (
        F.when(
            both,
            F.concat(F.lit("Value "), shown, F.lit(" is "), sigmas, F.lit(" standard deviations from the mean ("),
                     mean, F.lit(") and outside the IQR fence "), fence),
        )
        .when(
            F.col("is_zscore_outlier"),
            F.concat(F.lit("Value "), shown, F.lit(" is "), sigmas,
                     F.lit(" standard deviations from the column mean ("), mean, F.lit(")")),
        )
        .otherwise(F.concat(F.lit("Value "), shown, F.lit(" is outside the IQR fence "), fence))
    )
    return scored.select(
        *[ref(k) for k in key],
        "column_name",
        "value",
        "is_zscore_outlier",
        "is_iqr_outlier",
        F.col("_both").alias("is_consensus_outlier"),
        F.round("z", 4).alias("z_score"),
        F.round("abs_z", 4).alias("abs_z_score"),
        "iqr_direction",
        F.round("fence_distance", 4).alias("fence_distance"),
        "severity",
        F.round("_confidence", 4).alias("confidence"),
        description.alias("description"),
        *[
            F.round(c, 4).alias(c)
            for c in ("col_mean", "col_stddev", "q1", "q3", "iqr", "lower_fence", "upper_fence")
        ],
        "non_null_count",
    )


# ── single detectors ────────────────────────────────────────────────────────


def _record(column, method, kind, severity, confidence, value, score, description) -> list[Column]:
    return [
        F.lit(column).alias("column"),
        F.lit(method).alias("detection_method"),
        F.lit(kind).alias("anomaly_type"),
        (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
        (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"),
        F.lit(1).alias("rows_affected"),
        value.cast("string").alias("value"),
        score.cast("double").alias("score"),
        description.alias("description"),
    ]


def _zscore_item(df, column, facts: Facts, mad: float | None, threshold: float):
    if facts.n < 10 or not mad:
        return None
    value = number(df, column)
    z = 0.6745 * (value - F.lit(facts.median)) / F.lit(mad)
    size = F.abs(z)
    return (
        size >= threshold,
        _record(
            column, "ZScore", "outlier",
            F.when(size > 5, "high").otherwise("medium"),
            F.round(size / (size + threshold), 4),
            value, F.round(z, 4),
            F.concat(F.lit("Value "), fixed_point(value, 4), F.lit(f" in '{column}' has Z-score "),
                     fixed_point(z), F.lit(".")),
        ),
    )


def _iqr_item(df, column, facts: Facts, multiplier: float):
    if facts.n < 4 or facts.q3 == facts.q1:
        return None
    value = number(df, column)
    iqr = facts.q3 - facts.q1
    low, high = facts.q1 - multiplier * iqr, facts.q3 + multiplier * iqr
    above = value > F.lit(high)
    distance = F.when(above, value - F.lit(high)).otherwise(value - F.lit(low))
    return (
        (value < F.lit(low)) | above,
        _record(
            column, "IQR", "outlier", "low", 0.70, value, F.round(distance, 6),
            F.concat(F.lit("Value "), fixed_point(value, 4), F.lit(f" in '{column}' is "),
                     F.when(above, "above the upper").otherwise("below the lower"), F.lit(" IQR fence.")),
        ),
    )


@dataclass(frozen=True)
class Rule:
    """A domain rule: predicate(df, column, facts) is true for a violating row."""

    name: str
    semantic_types: frozenset[str]
    predicate: Callable[[DataFrame, str, Facts | None], Column]
    severity: str
    message: str


_RULES: dict[str, Rule] = {}


def register_rule(
    name: str,
    semantic_types: Sequence[str],
    predicate: Callable[[DataFrame, str, Facts | None], Column],
    severity: str = "high",
    message: str = "violates the rule",
) -> None:
    """Adds a rule (or replaces the one of the same name)."""
    _RULES[name] = Rule(name, frozenset(semantic_types), predicate, severity, message)


def _percentage_outside(df, column, facts):
    value = number(df, column)
    top = 1.0 if facts is not None and facts.high is not None and facts.high <= 1.0 else 100.0
    return (value < 0) | (value > top)


def _year_outside(df, column, facts):
    if kind_of(df.schema[column].dataType) == "text":
        year = F.substring(ref(column), 1, 4).try_cast("int")
    else:
        year = F.year(ref(column))
    return ~year.between(*YEARS)


def _not_a_count(df, column, facts):
    value = number(df, column)
    return (value != F.floor(value)) | (value < 0)


register_rule("negative_amount", ["currency", "numeric_count"],
              lambda df, c, f: number(df, c) < 0, "high", "is negative")
register_rule("percentage_range", ["percentage"], _percentage_outside, "high", "is outside the percentage range")
register_rule("whole_count", ["numeric_count"], _not_a_count, "medium", "is not a non-negative integer")
register_rule("year_range", ["date", "datetime"], _year_outside, "medium", "has an implausible year")
register_rule("email_shape", ["email"],
              lambda df, c, f: ~ref(c).rlike(EMAIL_SHAPE), "medium", "is not a valid email")


def _rule_items(df, column, semantic_type, facts):
    items = []
    for rule in _RULES.values():
        if semantic_type in rule.semantic_types:
            items.append(
                (
                    F.coalesce(rule.predicate(df, column, facts), F.lit(False)),
                    _record(
                        column, "Rule", "rule_violation", rule.severity, 0.95, ref(column), F.lit(0.95),
                        F.concat(F.lit("Value "), ref(column).cast("string"), F.lit(f" in '{column}' {rule.message}.")),
                    ),
                )
            )
    return items


def _cap(found: DataFrame, key: Sequence[str], max_results: int | None, by: Sequence[str]) -> DataFrame:
    """Strongest ``max_results`` per column and method (rank limit runs before the shuffle)."""
    if max_results is None:
        return found
    order = Window.partitionBy(*by).orderBy(F.desc(F.abs("score")), *[ref(k) for k in key])
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_results).drop("_r")


def _none(df: DataFrame, key: Sequence[str]) -> DataFrame:
    keys = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    return df.sparkSession.createDataFrame([], f"{keys}, {CANDIDATE}")


def modified_zscore(
    df: DataFrame, key: Sequence[str], columns: Sequence[str] | str,
    threshold: float = 3.0, max_results: int | None = None,
) -> DataFrame:
    """0.6745·(x − median)/MAD at or above the threshold; needs ten values and a spread."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    facts = column_facts(df, columns)
    mads = _absolute_deviation(df, facts)
    items = [i for c in columns if (i := _zscore_item(df, c, facts[c], mads.get(c), threshold))]
    if not items:
        return _none(df, key)
    return _cap(_flagged(df, key, items), key, max_results, ["column"])


def iqr_outliers(
    df: DataFrame, key: Sequence[str], columns: Sequence[str] | str,
    multiplier: float = 1.5, max_results: int | None = None,
) -> DataFrame:
    """Values outside the Tukey fence, ``score`` is the signed distance to the fence."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    facts = column_facts(df, columns)
    items = [i for c in columns if (i := _iqr_item(df, c, facts[c], multiplier))]
    if not items:
        return _none(df, key)
    return _cap(_flagged(df, key, items), key, max_results, ["column"])


def rule_violations(
    df: DataFrame, key: Sequence[str], types: Mapping[str, str], max_results: int | None = None
) -> DataFrame:
    """Domain rules for the given semantic types (column name -> type)."""
    percent = [c for c, t in types.items() if t == "percentage"]
    facts = column_facts(df, percent) if percent else {}
    items = [i for c, t in types.items() for i in _rule_items(df, c, t, facts.get(c))]
    if not items:
        return _none(df, key)
    return _cap(_flagged(df, key, items), key, max_results, ["column"])


# ── routing ─────────────────────────────────────────────────────────────────


def default_types(df: DataFrame) -> dict[str, str]:
    """Types by data type only, where no profile is at hand."""
    names = {"numeric": "numeric_measure", "datetime": "datetime", "boolean": "boolean"}
    return {f.name: names.get(kind_of(f.dataType), "unknown") for f in df.schema}


def detect_anomalies(
    df: DataFrame,
    key: Sequence[str],
    types: Mapping[str, str] | None = None,
    z_threshold: float = 3.0,
    iqr_multiplier: float = 1.5,
    max_per_column: int | None = None,
    forest: bool = True,
    contamination: float = 0.05,
) -> DataFrame:
    """All detectors that suit each column's semantic type, deduplicated per
    (column, row, anomaly type) by confidence.

    Thresholds: z 3.5 for currency, 4.0 for counts; fence 2.0 for currency.
    All per-column detectors share one scan.
    """
    types = {c: t for c, t in (types or default_types(df)).items() if c in df.columns and c not in key}
    numeric = [
        c for c, t in types.items()
        if kind_of(df.schema[c].dataType) == "numeric" and (t in NUMERIC_TYPES or t == "identifier" or t == "unknown")
    ]
    facts = column_facts(df, numeric)
    mads = _absolute_deviation(df, facts)
    items = []
    for c, t in types.items():
        if c in facts:
            z = {"currency": 3.5, "numeric_count": 4.0}.get(t, z_threshold)
            fence = 2.0 if t == "currency" else iqr_multiplier
            items += [
                i for i in (_zscore_item(df, c, facts[c], mads.get(c), z), _iqr_item(df, c, facts[c], fence)) if i
            ]
        items += _rule_items(df, c, t, facts.get(c))
    found = _flagged(df, key, items) if items else _none(df, key)
    found = _cap(found, key, max_per_column, ["column", "detection_method"])
    if forest and len(numeric) >= 2:
        from .forest import isolation_forest

        many = isolation_forest(
            df, key, numeric, contamination=contamination,
            max_results=None if max_per_column is None else 2 * max_per_column,
        )
        found = found.unionByName(many.select(*found.columns))
    return strongest(found, key)


def strongest(found: DataFrame, key: Sequence[str]) -> DataFrame:
    """The most confident record per (column, row, anomaly type)."""
    best = F.max_by(
        F.struct(*[c for c in found.columns if c not in {*key, "column", "anomaly_type"}]),
        F.struct(F.col("confidence"), -severity_rank(F.col("severity")), F.col("detection_method")),
    )
    kept = found.groupBy(*[ref(k) for k in key], "column", "anomaly_type").agg(best.alias("_best"))
    return kept.select(*[ref(k) for k in key], "column", "anomaly_type", "_best.*")


def rank_anomalies(found: DataFrame, key: Sequence[str], limit: int | None = None) -> DataFrame:
    """Severity, then confidence, then key."""
    ordered = found.orderBy(
        severity_rank(F.col("severity")), F.desc("confidence"), "column", *[ref(k) for k in key]
    )
    return ordered.limit(limit) if limit else ordered


def classify_alerts(found: DataFrame) -> DataFrame:
    """Alert severity by method, raised one level from confidence 0.9, with a suggested action."""
    method, given, confidence = F.col("detection_method"), F.col("severity"), F.col("confidence")
    level = (
        F.when(given == "critical", 3)
        .when((given == "high") | (F.col("anomaly_type") == "rule_violation"), 2)
        .when((method == "ZScore") & (confidence > 0.85), 2)
        .when(method.isin("ZScore", "IsolationForest"), 1)
        .otherwise(0)
    )
    level = F.least(level + F.when(confidence >= 0.9, 1).otherwise(0), F.lit(3))
    names = F.array(*[F.lit(s) for s in ("low", "medium", "high", "critical")])
    column = F.col("column")
    action = (
        F.when(F.col("anomaly_type") == "outlier",
               F.concat(F.lit("Investigate outlier values in '"), column, F.lit("'; consider capping or removal.")))
        .when(F.col("anomaly_type") == "rule_violation",
              F.concat(F.lit("Review data entry validation for '"), column, F.lit("' — invalid values detected.")))
        .when(F.col("anomaly_type") == "missing_pattern",
              F.concat(F.lit("Check upstream data pipeline for '"), column,
                       F.lit("'; systematic nulls may indicate an ETL issue.")))
        .when(F.col("anomaly_type") == "distribution_shift",
              F.concat(F.lit("'"), column, F.lit("' distribution has shifted; verify data source consistency.")))
        .otherwise("Review flagged rows for data quality issues.")
    )
    return found.withColumns(
        {"alert_severity": F.element_at(names, level + 1), "suggested_action": action}
    )


def urgent_alerts(alerts: DataFrame, severity: str = "alert_severity") -> DataFrame:
    """Only critical and high reach the alert channel (batch or stream)."""
    return alerts.where(F.col(severity).isin("critical", "high"))


def detection_recall(found: DataFrame, truth: DataFrame, key: Sequence[str], rows: int) -> DataFrame:
    """Recall on known anomalies and the share of other rows that were flagged."""
    flagged = found.select(*[ref(k) for k in key]).distinct().withColumn("_hit", F.lit(True))
    known = truth.select(*[ref(k) for k in key]).distinct().withColumn("_known", F.lit(True))
    both = flagged.join(known, list(key), "full")
    caught = F.count_if(F.col("_hit") & F.col("_known"))
    known_n = F.count("_known")
    extra = F.count_if(F.col("_hit") & F.col("_known").isNull())
    return both.agg(
        known_n.alias("known"),
        caught.alias("caught"),
        F.round(caught / F.nullif(known_n, F.lit(0)), 4).alias("recall"),
        F.round(extra / (F.lit(rows) - known_n), 6).alias("false_positive_rate"),
    )
