"""Registered queries: anomalies, profile, semantic types, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly, cleaning, forest, profiling, selecting
from .tables import rounded, table

QUERIES, ORACLES = {}, {}


def register(name, run, sql=None):
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def union(parts):
    return "\nUNION ALL\n".join(parts)


# ── anomalies ───────────────────────────────────────────────────────────────

CANDIDATE_COLUMNS = [
    "event_id", "column_name", "value", "is_zscore_outlier", "is_iqr_outlier", "is_consensus_outlier", "z_score",
    "abs_z_score", "iqr_direction", "fence_distance", "severity", "confidence", "col_mean", "col_stddev", "q1", "q3",
    "iqr", "lower_fence", "upper_fence", "non_null_count",
]


def _shares(spark, sf):
    """Event values as a quotient, so that no rounding tie depends on the engine."""
    return table(spark, sf, "events").select("event_id", (F.col("value") / 3.7).alias("value"))


def _candidate_sql(deviation, limit):
    return f"""WITH quotients AS (SELECT event_id, value / 3.7::DOUBLE AS value FROM events),
s AS (SELECT AVG(value) AS m, {deviation}(value) AS sd, quantile_cont(value, 0.25) AS q1,
   quantile_cont(value, 0.75) AS q3, COUNT(value) AS n FROM quotients WHERE value IS NOT NULL),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM s),
x AS (SELECT event_id, value, (value - m) / NULLIF(sd, 0) AS z, value < lo OR value > hi AS out,
   CASE WHEN value < lo THEN 'low' WHEN value > hi THEN 'high' ELSE 'normal' END AS dir,
   GREATEST(lo - value, value - hi, 0) AS dist, f.* FROM quotients CROSS JOIN f WHERE value IS NOT NULL),
c AS (SELECT *, ABS(z) >= 3.0 AS far, ABS(z) >= 3.0 AND out AS agree FROM x WHERE ABS(z) >= 3.0 OR out),
g AS (SELECT *, CASE WHEN agree AND ABS(z) >= 5 THEN 'critical' WHEN agree THEN 'high' WHEN ABS(z) >= 4 THEN 'high'
   WHEN far THEN 'medium' ELSE 'low' END AS severity FROM c)
SELECT event_id, 'value' AS column_name, value, far AS is_zscore_outlier, out AS is_iqr_outlier, agree AS is_consensus_outlier,
  ROUND(z, 4) AS z_score, ROUND(ABS(z), 4) AS abs_z_score, dir AS iqr_direction, ROUND(dist, 4) AS fence_distance, severity,
  ROUND(LEAST(1.0, 0.5 * LEAST(ABS(z) / 6.0, 1.0) + 0.5 * CASE WHEN agree THEN 1.0 WHEN out THEN 0.6 ELSE 0.3 END), 4) AS confidence,
  ROUND(m, 4) AS col_mean, ROUND(sd, 4) AS col_stddev, ROUND(q1, 4) AS q1, ROUND(q3, 4) AS q3, ROUND(iqr, 4) AS iqr,
  ROUND(lo, 4) AS lower_fence, ROUND(hi, 4) AS upper_fence, n AS non_null_count
FROM g ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, ABS(z) DESC, event_id {limit}"""


register(
    "two_method_candidates",
    lambda spark, sf: anomaly.two_method_candidates(_shares(spark, sf), ["event_id"], "value").select(
        *CANDIDATE_COLUMNS
    ),
    _candidate_sql("STDDEV_POP", ""),
)
register(
    "two_method_candidates_all_sample_deviation",
    lambda spark, sf: anomaly.two_method_candidates(
        _shares(spark, sf), ["event_id"], "value", limit=None, stddev="samp"
    ).select(*CANDIDATE_COLUMNS),
    _candidate_sql("STDDEV_SAMP", ""),
)

register(
    "modified_zscore",
    lambda spark, sf: anomaly.modified_zscore(table(spark, sf, "events"), ["event_id"], "value", 3.0)
    .select("event_id", "column", "detection_method", "severity", "confidence", "score"),
    """WITH m AS (SELECT MEDIAN(value) AS med FROM events), d AS (SELECT MEDIAN(ABS(value - med)) AS mad FROM events, m),
z AS (SELECT event_id, 0.6745 * (value - med) / mad AS z FROM events, m, d)
SELECT event_id, 'value' AS column, 'ZScore' AS detection_method, CASE WHEN ABS(z) > 5 THEN 'high' ELSE 'medium' END AS severity,
  ROUND(ABS(z) / (ABS(z) + 3.0), 4) AS confidence, ROUND(z, 4) AS score
FROM z WHERE ABS(z) >= 3.0 ORDER BY ABS(ROUND(z, 4)) DESC, event_id""",
)
register(
    "fence_outliers",
    lambda spark, sf: anomaly.iqr_outliers(table(spark, sf, "events"), ["event_id"], "value", 1.5, None)
    .select("event_id", "column", "detection_method", "severity", "confidence", "score"),
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT event_id, 'value' AS column, 'IQR' AS detection_method, 'low' AS severity, 0.7 AS confidence,
  ROUND(CASE WHEN value > hi THEN value - hi ELSE value - lo END, 6) AS score
FROM events, f WHERE value < lo OR value > hi""",
)


def _suspicious(spark, sf):
    """Order lines per part with values that break the domain rules."""
    return table(spark, sf, "part").select(
        "p_partkey",
        (F.col("p_retailprice") - 950).alias("margin_amount"),
        (F.col("p_size") / 40.0).alias("fill_rate"),
        (F.col("p_size") / 2.0).alias("n_boxes"),
        F.concat(F.col("p_name"), F.when(F.col("p_size") > 10, "@parts.example.com").otherwise("")).alias("contact"),
        F.concat((F.col("p_size") * 100).cast("string"), F.lit("-01-01")).alias("made_on"),
    )


RULE_TYPES = {
    "margin_amount": "currency", "fill_rate": "percentage", "n_boxes": "numeric_count", "contact": "email",
    "made_on": "date",
}
_SUSPICIOUS_SQL = """(SELECT p_partkey, p_retailprice - 950 AS margin_amount, p_size / 40.0 AS fill_rate, p_size / 2.0 AS n_boxes,
  p_name || CASE WHEN p_size > 10 THEN '@parts.example.com' ELSE '' END AS contact,
  (p_size * 100)::VARCHAR || '-01-01' AS made_on FROM part)"""


def _rule_sql(column, severity, condition):
    return f"""SELECT p_partkey, '{column}' AS "column", 'Rule' AS detection_method, 'rule_violation' AS anomaly_type,
  '{severity}' AS severity, 0.95 AS confidence FROM {_SUSPICIOUS_SQL} WHERE {condition}"""


_RULE_PARTS = [
    _rule_sql("margin_amount", "high", "margin_amount < 0"),
    _rule_sql("fill_rate", "high", "fill_rate < 0 OR fill_rate > CASE WHEN (SELECT MAX(p_size) / 40.0 FROM part) <= 1 THEN 1 ELSE 100 END"),
    _rule_sql("n_boxes", "high", "n_boxes < 0"),
    _rule_sql("n_boxes", "medium", "n_boxes <> FLOOR(n_boxes) OR n_boxes < 0"),
    _rule_sql("contact", "medium", r"NOT regexp_matches(contact, '^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$')"),
    _rule_sql("made_on", "medium", "NOT TRY_CAST(SUBSTRING(made_on, 1, 4) AS INTEGER) BETWEEN 1900 AND 2100"),
]
register(
    "rule_violations",
    lambda spark, sf: anomaly.rule_violations(_suspicious(spark, sf), ["p_partkey"], RULE_TYPES, None).select(
        "p_partkey", "column", "detection_method", "anomaly_type", "severity", "confidence"
    ),
    union(_RULE_PARTS),
)


register(
    "routed_anomalies",
    lambda spark, sf: anomaly.detect_anomalies(
        table(spark, sf, "events").select("event_id", "value", F.lit(1.5).alias("unit")), ["event_id"],
        {"value": "numeric_measure", "unit": "numeric_count"}, max_per_column=None, forest=False,
    ).select("event_id", "column", "anomaly_type", "detection_method", "severity", "confidence"),
    """WITH m AS (SELECT MEDIAN(value) AS med, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
d AS (SELECT MEDIAN(ABS(value - med)) AS mad FROM events, m),
a AS (
  SELECT event_id, 'ZScore' AS detection_method, CASE WHEN ABS(0.6745 * (value - med) / mad) > 5 THEN 'high' ELSE 'medium' END AS severity,
    ROUND(ABS(0.6745 * (value - med) / mad) / (ABS(0.6745 * (value - med) / mad) + 3.0), 4) AS confidence
  FROM events, m, d WHERE ABS(0.6745 * (value - med) / mad) >= 3.0
  UNION ALL SELECT event_id, 'IQR', 'low', 0.7 FROM events, m
  WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))
SELECT event_id, 'value' AS "column", 'outlier' AS anomaly_type, detection_method, severity, confidence FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY confidence DESC,
    CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, detection_method DESC) AS r FROM a) WHERE r = 1
UNION ALL
SELECT event_id, 'unit', 'rule_violation', 'Rule', 'medium', 0.95 FROM events""",
)


def _routed_with_forest(spark, sf):
    """Orders of which every 1,500th is far off in two measures together, routed with the defaults: what each method finds of them."""
    far = F.col("o_orderkey") % 1500 == 0
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.when(far, 9e8).otherwise(F.col("o_totalprice")).alias("price"), F.when(far, 8e8).otherwise(F.col("o_custkey")).alias("customer")
    )
    found = anomaly.detect_anomalies(orders, ["o_orderkey"], {"price": "numeric_measure", "customer": "numeric_measure"}, max_per_column=None)
    hits = found.where(F.col("o_orderkey") % 1500 == 0).groupBy("detection_method").agg(F.count_distinct("o_orderkey").alias("planted_found"))
    return hits.where(F.col("detection_method").isin("ZScore", "IsolationForest"))


register(
    "routed_with_forest",
    _routed_with_forest,
    "SELECT m AS detection_method, COUNT(*) FILTER (o_orderkey % 1500 = 0) AS planted_found FROM orders, (SELECT UNNEST(['ZScore', 'IsolationForest']) AS m) GROUP BY m",
)


def _alerts(spark, sf):
    found = anomaly.two_method_candidates(_shares(spark, sf), ["event_id"], "value", limit=None)
    return found.select(
        "event_id", F.col("column_name").alias("column"), F.lit("ZScore").alias("detection_method"),
        F.lit("outlier").alias("anomaly_type"), "severity", "confidence",
    )


_ALERT_SQL = f"""WITH g AS ({_candidate_sql("STDDEV_POP", "")}),
b AS (SELECT event_id, severity, confidence, CASE WHEN severity = 'critical' THEN 3 WHEN severity = 'high' THEN 2
   WHEN confidence > 0.85 THEN 2 ELSE 1 END AS level FROM g),
e AS (SELECT *, LEAST(3, level + CASE WHEN confidence >= 0.9 THEN 1 ELSE 0 END) AS raised FROM b)
SELECT event_id, 'value' AS "column", severity, confidence,
  CASE raised WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS alert_severity,
  'Investigate outlier values in ''value''; consider capping or removal.' AS suggested_action FROM e"""
register(
    "classified_alerts",
    lambda spark, sf: anomaly.classify_alerts(_alerts(spark, sf)).drop("detection_method", "anomaly_type"),
    _ALERT_SQL,
)
register(
    "urgent_alerts",
    lambda spark, sf: anomaly.urgent_alerts(
        anomaly.classify_alerts(_alerts(spark, sf)).drop("detection_method", "anomaly_type")
    ),
    f"SELECT * FROM ({_ALERT_SQL}) WHERE alert_severity IN ('critical', 'high')",
)
register(
    "detection_recall",
    lambda spark, sf: anomaly.detection_recall(
        anomaly.two_method_candidates(_shares(spark, sf), ["event_id"], "value", limit=None),
        table(spark, sf, "events").where("value > 100"), ["event_id"], table(spark, sf, "events").count(),
    ),
    f"""WITH g AS ({_candidate_sql("STDDEV_POP", "")}), k AS (SELECT event_id FROM events WHERE value > 100),
c AS (SELECT (SELECT COUNT(*) FROM k) AS known, (SELECT COUNT(*) FROM g WHERE event_id IN (SELECT event_id FROM k)) AS caught,
  (SELECT COUNT(*) FROM g WHERE event_id NOT IN (SELECT event_id FROM k)) AS extra, (SELECT COUNT(*) FROM events) AS n)
SELECT known, caught, ROUND(caught / known, 4) AS recall, ROUND(extra / (n - known), 6) AS false_positive_rate FROM c""",
)
register(
    "isolation_forest",
    lambda spark, sf: forest.isolation_forest(
        table(spark, sf, "part"), ["p_partkey"], ["p_size", "p_retailprice"], max_results=None
    ),
)
register(
    "isolation_forest_scores",
    lambda spark, sf: forest.score_rows(
        table(spark, sf, "orders").withColumn("day", F.dayofyear("o_orderdate")), ["o_orderkey"], ["o_totalprice", "day"]
    ),
)

# ── profile ─────────────────────────────────────────────────────────────────


def _messy_orders(spark, sf):
    """Orders with missing values and exact duplicates, derived from the given table."""
    orders = table(spark, sf, "orders").select(
        "o_custkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("order_status"),
        F.when(F.col("o_totalprice") < 250000, F.col("o_totalprice")).alias("total_price"),
        "o_orderdate",
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
    )
    return orders.unionAll(orders.where("o_custkey < 400"))


MESSY_ORDERS = """(WITH o AS (SELECT o_custkey, NULLIF(o_orderstatus, 'P') AS order_status,
  CASE WHEN o_totalprice < 250000 THEN o_totalprice END AS total_price, o_orderdate,
  NULLIF(o_orderpriority, '5-LOW') AS priority FROM orders)
SELECT * FROM o UNION ALL SELECT * FROM o WHERE o_custkey < 400)"""

PROFILE_COLUMNS = [
    "ordinal", "column_name", "kind", "total_rows", "non_null_count", "null_count", "null_rate", "completeness",
    "unique_count", "cardinality_ratio", "is_high_cardinality", "is_constant", "mean", "stddev", "min_val", "max_val",
    "p05", "p25", "p50", "p75", "p95", "skewness", "kurtosis", "cv", "iqr", "outlier_count_iqr", "entropy", "normalised_entropy",
    "top3_coverage", "min_length", "max_length", "avg_length", "has_whitespace", "semantic_type", "confidence", "needs_review",
]


def _profile_sql(i, column, kind, semantic, confidence):
    numeric, text = kind == "numeric", kind == "text"
    num = lambda e, t="DOUBLE": e if numeric else f"NULL::{t}"
    txt = lambda e, t: e if text else f"NULL::{t}"
    v = f"{column}::DOUBLE"
    quant = {n: num(f"ROUND(quantile_cont({v}, {p}), 4)") for n, p in
             (("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95))}
    q1, q3 = f"quantile_cont({v}, 0.25)", f"quantile_cont({v}, 0.75)"
    outliers = (
        f"(SELECT COUNT(*) FROM t, (SELECT {q1} AS a, {q3} AS b FROM t) WHERE {v} < a - 1.5 * (b - a) OR {v} > b + 1.5 * (b - a))"
        if numeric else "NULL::BIGINT"
    )
    return f"""SELECT {i} AS ordinal, '{column}' AS column_name, '{kind}' AS kind, COUNT(*) AS total_rows, COUNT({column}) AS non_null_count,
  COUNT(*) - COUNT({column}) AS null_count, ROUND((COUNT(*) - COUNT({column})) / COUNT(*), 6) AS null_rate,
  ROUND(COUNT({column}) / COUNT(*), 6) AS completeness, COUNT(DISTINCT {column}) AS unique_count,
  ROUND(COUNT(DISTINCT {column}) / COUNT({column}), 6) AS cardinality_ratio,
  COUNT(DISTINCT {column}) / COUNT({column}) > 0.5 AS is_high_cardinality, COUNT(DISTINCT {column}) = 1 AS is_constant,
  {num(f"ROUND(AVG({v}), 4)")} AS mean, {num(f"ROUND(STDDEV_SAMP({v}), 4)")} AS stddev,
  {num(f"ROUND(MIN({v}), 4)")} AS min_val, {num(f"ROUND(MAX({v}), 4)")} AS max_val,
  {", ".join(f"{e} AS {n}" for n, e in quant.items())},
  {num(f"(SELECT ROUND(AVG(POWER({v} - m, 3)) / POWER(AVG(POWER({v} - m, 2)), 1.5), 4) FROM t, (SELECT AVG({v}) AS m FROM t) s)")} AS skewness,
  {num(f"(SELECT ROUND(AVG(POWER({v} - m, 4)) / POWER(AVG(POWER({v} - m, 2)), 2) - 3, 4) FROM t, (SELECT AVG({v}) AS m FROM t) s)")} AS kurtosis,
  {num(f"ROUND(ABS(STDDEV_SAMP({v}) / NULLIF(AVG({v}), 0)), 6)")} AS cv,
  {num(f"ROUND({q3} - {q1}, 4)")} AS iqr, {outliers} AS outlier_count_iqr,
  (SELECT ROUND(-SUM(p * LOG2(p)), 6) FROM (SELECT COUNT(*) / SUM(COUNT(*)) OVER () AS p FROM t WHERE {column} IS NOT NULL GROUP BY {column})) AS entropy,
  (SELECT ROUND(-SUM(p * LOG2(p)) / LOG2(COUNT(*)), 6) FROM (SELECT COUNT(*) / SUM(COUNT(*)) OVER () AS p FROM t WHERE {column} IS NOT NULL GROUP BY {column})) AS normalised_entropy,
  (SELECT ROUND(SUM(n) / MAX(total), 6) FROM (SELECT COUNT(*) AS n, SUM(COUNT(*)) OVER () AS total FROM t WHERE {column} IS NOT NULL
     GROUP BY {column} ORDER BY n DESC LIMIT 3)) AS top3_coverage,
  {txt(f"MIN(LENGTH({column}))::INTEGER", "INTEGER")} AS min_length, {txt(f"MAX(LENGTH({column}))::INTEGER", "INTEGER")} AS max_length,
  {txt(f"ROUND(AVG(LENGTH({column})), 2)", "DOUBLE")} AS avg_length,
  {txt(f"BOOL_OR(regexp_matches({column}, '^\\s|\\s$'))", "BOOLEAN")} AS has_whitespace,
  '{semantic}' AS semantic_type, {confidence} AS confidence, {semantic in ("free_text", "unknown")} AS needs_review
FROM t"""


_MESSY_PROFILE = [
    ("o_custkey", "numeric", "numeric_count", 0.70),
    ("order_status", "text", "categorical", 0.80),
    ("total_price", "numeric", "currency", 0.90),
    ("o_orderdate", "datetime", "datetime", 1.0),
    ("priority", "text", "categorical", 0.80),
]
_PROFILE_ROUNDED = ["mean", "stddev", "min_val", "max_val", "p05", "p25", "p50", "p75", "p95", "skewness", "kurtosis", "iqr"]
register(
    "profile_columns",
    lambda spark, sf: rounded(
        profiling.profile_table(_messy_orders(spark, sf)).columns.select(*PROFILE_COLUMNS), _PROFILE_ROUNDED
    ),
    f"WITH t AS (SELECT * FROM {MESSY_ORDERS})\n" + union(_profile_sql(i, *c) for i, c in enumerate(_MESSY_PROFILE)),
)
register(
    "profile_table",
    lambda spark, sf: profiling.profile_table(_messy_orders(spark, sf)).table,
    f"""WITH t AS (SELECT * FROM {MESSY_ORDERS}), c AS (SELECT COUNT(*) AS n, (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM t)) AS d,
  SUM((order_status IS NULL)::INT + (total_price IS NULL)::INT + (priority IS NULL)::INT)::BIGINT AS missing FROM t),
s AS (SELECT *, ROUND(1 - missing / (n * 5), 6) AS complete, ROUND(1 - (n - d) / n, 6) AS consistent FROM c),
o AS (SELECT *, ROUND((complete + consistent) / 2, 4) AS overall FROM s)
SELECT n AS row_count, 5 AS column_count, n - d AS duplicate_count, missing AS missing_cells, complete AS completeness_score,
  consistent AS consistency_score, TRUE AS has_time_series, overall AS overall_quality,
  CASE WHEN overall >= 0.95 THEN 'A' WHEN overall >= 0.85 THEN 'B' WHEN overall >= 0.7 THEN 'C' WHEN overall >= 0.55 THEN 'D' ELSE 'F' END AS quality_grade
FROM o""",
)
register(
    "duplicate_rows",
    lambda spark, sf: profiling.duplicate_rows(table(spark, sf, "documents").select("text", "lang")),
    "SELECT COUNT(*) AS row_count, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicate_count FROM documents",
)
register(
    "profile_documents",
    lambda spark, sf: profiling.profile_table(table(spark, sf, "documents")).columns.select(
        "column_name", "kind", "null_count", "unique_count", "min_length", "max_length", "avg_length", "semantic_type"
    ),
    union(
        f"""SELECT '{c}' AS column_name, '{k}' AS kind, COUNT(*) - COUNT({c}) AS null_count, COUNT(DISTINCT {c}) AS unique_count,
  {f"MIN(LENGTH({c}))::INTEGER" if k == "text" else "NULL::INTEGER"} AS min_length,
  {f"MAX(LENGTH({c}))::INTEGER" if k == "text" else "NULL::INTEGER"} AS max_length,
  {f"ROUND(AVG(LENGTH({c})), 2)" if k == "text" else "NULL::DOUBLE"} AS avg_length, {s} AS semantic_type FROM documents"""
        for c, k, s in (
            ("doc_id", "numeric", "'identifier'"), ("text", "text", "'free_text'"),
            ("lang", "text", "CASE WHEN COUNT(DISTINCT lang) / COUNT(lang) <= 0.05 THEN 'categorical' ELSE 'free_text' END"),
            ("source", "text", "CASE WHEN COUNT(DISTINCT source) / COUNT(source) <= 0.05 THEN 'categorical' ELSE 'free_text' END"),
            ("n_chars", "numeric", "'numeric_count'"),
        )
    ),
)

# Expected type per column, from the rules (fixed by column name and data type).
_TYPE_ROWS = {
    "lineitem": [
        ("l_orderkey", "numeric_count", 0.70), ("l_partkey", "numeric_count", 0.70), ("l_suppkey", "identifier", 0.80),
        ("l_linenumber", "numeric_count", 0.70), ("l_quantity", "numeric_count", 0.80), ("l_extendedprice", "currency", 0.90),
        ("l_discount", "percentage", 0.85), ("l_tax", "currency", 0.90), ("l_returnflag", "categorical", 0.80),
        ("l_linestatus", "categorical", 0.80), ("l_shipdate", "datetime", 1.0),
    ],
}
register(
    "semantic_types",
    lambda spark, sf: profiling.profile_table(table(spark, sf, "lineitem")).columns.select(
        "column_name", "semantic_type", "confidence", "needs_review"
    ),
    union(
        f"SELECT '{c}' AS column_name, '{t}' AS semantic_type, {p} AS confidence, FALSE AS needs_review"
        for c, t, p in _TYPE_ROWS["lineitem"]
    ),
)
register(
    "schema_columns",
    lambda spark, sf: profiling.schema_columns(profiling.profile_table(table(spark, sf, "orders")).columns).select(
        "name", "semantic_type", "nullable", "null_rate", "unique_count", "missing_count", "is_primary_key"
    ),
    union(
        f"""SELECT '{c}' AS name, '{t}' AS semantic_type, COUNT(*) > COUNT({c}) AS nullable,
  ROUND((COUNT(*) - COUNT({c})) / COUNT(*), 4) AS null_rate, COUNT(DISTINCT {c}) AS unique_count, COUNT(*) - COUNT({c}) AS missing_count,
  '{t}' = 'identifier' AND COUNT(DISTINCT {c}) = COUNT(*) AS is_primary_key FROM orders"""
        for c, t in (
            ("o_orderkey", "numeric_count"), ("o_custkey", "numeric_count"), ("o_orderstatus", "categorical"),
            ("o_totalprice", "currency"), ("o_orderdate", "datetime"), ("o_orderpriority", "categorical"),
        )
    ),
)
register(
    "schema_summary",
    lambda spark, sf: profiling.schema_summary(profiling.profile_table(table(spark, sf, "lineitem")).columns),
    "SELECT COUNT(*) AS row_count, 11 AS column_count, TRUE AS has_time_series, 7 AS numeric_column_count, 0 AS ambiguous_count FROM lineitem",
)
register(
    "forecast_candidates",
    lambda spark, sf: profiling.forecast_candidates(
        profiling.profile_table(table(spark, sf, "lineitem")).columns
    ).select("viable", "reason", F.concat_ws(",", "date_columns").alias("date_columns"),
             F.concat_ws(",", "target_columns").alias("target_columns")),
    """SELECT COUNT(*) >= 30 AS viable, 'Forecasting conditions met' AS reason, 'l_shipdate' AS date_columns,
'l_extendedprice,l_tax,l_orderkey,l_partkey,l_linenumber,l_quantity' AS target_columns FROM lineitem""",
)
register(
    "ml_target",
    lambda spark, sf: profiling.ml_target(profiling.profile_table(table(spark, sf, "lineitem")).columns),
    "SELECT 'l_extendedprice' AS column_name, 'currency' AS semantic_type FROM lineitem LIMIT 1",
)

# ── cleaning ────────────────────────────────────────────────────────────────


def _raw_sales(spark, sf):
    """Text columns as they come from a file: currency signs, padding, missing values, repeats."""
    orders = table(spark, sf, "orders").select(
        "o_custkey",
        F.concat(F.lit(" "), F.nullif("o_orderstatus", F.lit("P")), F.lit("  ")).alias("region"),
        F.when(F.col("o_totalprice") < 250000,
               F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).alias("revenue"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.when(F.col("o_totalprice") > 480000, F.lit("yes")).alias("note"),
        F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice")).alias("amount"),
    )
    return orders.unionAll(orders.where("o_custkey < 400"))


SALES_TYPES = {
    "o_custkey": "identifier", "region": "categorical", "revenue": "currency", "order_date": "datetime",
    "note": "categorical", "amount": "currency",
}
_SALES_SQL = """WITH o AS (SELECT o_custkey, NULLIF(o_orderstatus, 'P') AS region,
  CASE WHEN o_totalprice < 250000 THEN o_totalprice END AS revenue, o_orderdate AS order_date,
  CASE WHEN o_totalprice > 480000 THEN 'yes' END AS note, CASE WHEN o_totalprice > 50000 THEN o_totalprice END AS amount FROM orders),
raw AS (SELECT * FROM o UNION ALL SELECT * FROM o WHERE o_custkey < 400),
d AS (SELECT DISTINCT * FROM raw),
fill AS (SELECT MEDIAN(revenue) AS revenue, MEDIAN(amount) AS amount,
  (SELECT region FROM d WHERE region IS NOT NULL GROUP BY region ORDER BY COUNT(*) DESC, region LIMIT 1) AS region FROM d)"""


def _clean_sales(spark, sf):
    return cleaning.clean(_raw_sales(spark, sf), SALES_TYPES)


register(
    "cleaned_rows",
    lambda spark, sf: _clean_sales(spark, sf).data.select(
        "o_custkey", "region", F.round("revenue", 2).alias("revenue"),
        F.date_format("order_date", "yyyy-MM-dd").alias("order_date"), F.round("amount", 2).alias("amount"),
    ),
    _SALES_SQL + """
SELECT o_custkey, COALESCE(d.region, fill.region) AS region, ROUND(COALESCE(d.revenue, fill.revenue), 2) AS revenue,
  STRFTIME(order_date, '%Y-%m-%d') AS order_date, ROUND(COALESCE(d.amount, fill.amount), 2) AS amount FROM d, fill""",
)
register(
    "cleaning_steps",
    lambda spark, sf: _clean_sales(spark, sf).steps.select("step_no", "action", "column", "rows_affected"),
    _SALES_SQL + """
SELECT 1 AS step_no, 'remove_duplicates' AS action, NULL AS "column", (SELECT COUNT(*) FROM raw) - COUNT(*) AS rows_affected FROM d
UNION ALL SELECT 2, 'coerce_to_float', 'revenue', COUNT(revenue) FROM d
UNION ALL SELECT 3, 'coerce_to_datetime', 'order_date', COUNT(order_date) FROM d
UNION ALL SELECT 4, 'drop_column_high_null', 'note', 0
UNION ALL SELECT 5, 'impute_mode', 'region', COUNT(*) - COUNT(region) FROM d
UNION ALL SELECT 6, 'impute_median', 'revenue', COUNT(*) - COUNT(revenue) FROM d
UNION ALL SELECT 7, 'impute_median', 'amount', COUNT(*) - COUNT(amount) FROM d""",
)
register(
    "cleaning_report",
    lambda spark, sf: _clean_sales(spark, sf).report.select(
        "rows_before", "rows_after", "columns_before", "columns_after", "rows_removed", "columns_removed"
    ),
    _SALES_SQL + """
SELECT (SELECT COUNT(*) FROM raw) AS rows_before, COUNT(*) AS rows_after, 6 AS columns_before, 5 AS columns_after,
  (SELECT COUNT(*) FROM raw) - COUNT(*) AS rows_removed, 1 AS columns_removed FROM d""",
)
register(
    "clipped_values",
    lambda spark, sf: (
        lambda df: cleaning.clip(df, cleaning.clip_bounds(df, ["value"], 3.0))
    )(table(spark, sf, "events").select("event_id", "value")).withColumn("value", F.round("value", 4)),
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT event_id, ROUND(GREATEST(LEAST(value, b + 3.0 * (b - a)), a - 3.0 * (b - a)), 4) AS value FROM events, q""",
)
register(
    "deduplicated_rows",
    lambda spark, sf: cleaning.drop_duplicates(table(spark, sf, "documents").select("text", "lang")).select(
        "lang", F.md5("text").alias("digest")
    ),
    "SELECT lang, MD5(text) AS digest FROM (SELECT DISTINCT text, lang FROM documents)",
)
register(
    "parsed_numbers",
    lambda spark, sf: cleaning.coerce_types(
        table(spark, sf, "customer").select(
            "c_custkey", F.concat(F.lit("€ "), F.format_number("c_acctbal", 2)).alias("balance")
        ), {"balance": "currency"},
    ),
    "SELECT c_custkey, c_acctbal AS balance FROM customer",
)


# ── samples and ranking ─────────────────────────────────────────────────────

register(
    "sampled_rows",
    lambda spark, sf: selecting.sample_rows(table(spark, sf, "part"), n=40).join(table(spark, sf, "part").select("p_partkey"), "p_partkey", "left_semi").agg(
        F.count("*").alias("n"), F.count_distinct("p_partkey").alias("different")
    ),
    "SELECT LEAST(40, COUNT(*)) AS n, LEAST(40, COUNT(*)) AS different FROM part",
)
register(
    "sample_value_counts",
    lambda spark, sf: profiling.profile_table(table(spark, sf, "part")).columns.select("column_name", F.size("sample_values").alias("samples")),
    union(
        f"SELECT '{c}' AS column_name, LEAST(5, COUNT(DISTINCT {c}))::INTEGER AS samples FROM part"
        for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    ),
)
register(
    "ranked_anomalies",
    lambda spark, sf: anomaly.rank_anomalies(
        anomaly.modified_zscore(table(spark, sf, "events"), ["event_id"], "value"), ["event_id"], 40
    ).select("event_id", "severity", "confidence"),
    """WITH m AS (SELECT MEDIAN(value) AS med FROM events), d AS (SELECT MEDIAN(ABS(value - med)) AS mad FROM events, m),
z AS (SELECT event_id, ABS(0.6745 * (value - med) / mad) AS z FROM events, m, d),
r AS (SELECT event_id, CASE WHEN z > 5 THEN 'high' ELSE 'medium' END AS severity, ROUND(z / (z + 3.0), 4) AS confidence FROM z WHERE z >= 3.0)
SELECT * FROM r ORDER BY CASE severity WHEN 'high' THEN 1 ELSE 2 END, confidence DESC, event_id LIMIT 40""",
)
