"""Registered queries: scores, insights, operational tables, files, keys, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns, fixed
from ..operators import anomaly, forecasting, operations, profiling, scoring
from ..session import new_folder
from ..sources import files, sinks
from ..streaming import events as streams
from ..streaming import stateful
from .quality_queries import MESSY_ORDERS, _messy_orders, _shares
from .tables import table

QUERIES, ORACLES = {}, {}


def register(name, run, sql=None):
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


# ── scores, cards, insights ─────────────────────────────────────────────────

_FACTS = f"""t AS (SELECT * FROM {MESSY_ORDERS}), c AS (SELECT COUNT(*) AS n, (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM t)) AS d,
  SUM((order_status IS NULL)::INT + (total_price IS NULL)::INT + (priority IS NULL)::INT)::BIGINT AS missing,
  ((COUNT(*) FILTER (WHERE order_status IS NULL) < 0.2 * COUNT(*))::INT + (COUNT(*) FILTER (WHERE total_price IS NULL) < 0.2 * COUNT(*))::INT
   + (COUNT(*) FILTER (WHERE priority IS NULL) < 0.2 * COUNT(*))::INT + 2) / 5 AS valid, AVG(total_price) AS price FROM t),
s AS (SELECT *, n - d AS dup, ROUND(1 - missing / (n * 5), 6) AS complete, ROUND(1 - (n - d) / n, 6) AS consistent FROM c)"""
_GRADE = "CASE WHEN {x} >= 0.95 THEN 'A' WHEN {x} >= 0.85 THEN 'B' WHEN {x} >= 0.7 THEN 'C' WHEN {x} >= 0.55 THEN 'D' ELSE 'F' END"


def _profile(spark, sf):
    return profiling.profile_table(_messy_orders(spark, sf))


register(
    "quality_score",
    lambda spark, sf: scoring.quality_score(_profile(spark, sf)),
    f"""WITH {_FACTS}, o AS (SELECT *, ROUND(valid, 4) AS v, ROUND(complete * 0.4 + consistent * 0.3 + ROUND(valid, 4) * 0.2 + 0.1, 4) AS overall FROM s)
SELECT complete AS completeness, consistent AS consistency, v AS validity, 1.0 AS timeliness, overall AS overall_score,
  {_GRADE.format(x="overall")} AS grade FROM o""",
)
_KPI_SQL = f"""WITH {_FACTS} SELECT 'Total Rows' AS name, n::DOUBLE AS value, 'rows' AS unit, 'integer' AS format, NULL AS benchmark FROM s
UNION ALL SELECT 'Columns', 5, 'cols', 'integer', NULL FROM s
UNION ALL SELECT 'Completeness', ROUND(complete * 100, 1), '%', 'percent', 95.0 FROM s
UNION ALL SELECT 'Consistency', ROUND(consistent * 100, 1), '%', 'percent', 95.0 FROM s
UNION ALL SELECT 'Duplicate Rows', dup, 'rows', 'integer', NULL FROM s
UNION ALL SELECT 'Avg total_price', ROUND(price, 2), '', 'currency', NULL FROM s"""
register(
    "kpi_cards",
    lambda spark, sf: scoring.kpi_cards(_profile(spark, sf)).drop("position"),
    _KPI_SQL,
)
register(
    "basic_insights",
    lambda spark, sf: scoring.basic_insights(_profile(spark, sf).table).select(
        "position", "headline", "business_impact", "confidence"
    ),
    f"""WITH {_FACTS} SELECT 1 AS position, 'Dataset contains ' || format('{{:,}}', n) || ' rows across 5 columns' AS headline,
  'medium' AS business_impact, 1.0 AS confidence FROM s
UNION ALL SELECT 2, 'Data completeness is ' || printf('%.1f', complete * 100) || '%', CASE WHEN complete < 0.9 THEN 'high' ELSE 'low' END, 1.0 FROM s
UNION ALL SELECT 3, format('{{:,}}', dup) || ' duplicate rows detected', 'medium', 1.0 FROM s WHERE dup > 0""",
)
register(
    "summary_sentence",
    lambda spark, sf: (lambda t: scoring.summary_sentence(t, scoring.basic_insights(t)))(_profile(spark, sf).table),
    f"""WITH {_FACTS} SELECT 'The dataset contains ' || format('{{:,}}', n) || ' rows and 5 columns with a completeness score of ' ||
  printf('%.1f', complete * 100) || '%. Key finding: Dataset contains ' || format('{{:,}}', n) || ' rows across 5 columns.' AS summary FROM s""",
)
register(
    "basic_recommendations",
    lambda spark, sf: scoring.basic_recommendations(scoring.basic_insights(_profile(spark, sf).table)),
    f"""WITH {_FACTS} SELECT 'Address: ' || SUBSTRING('Dataset contains ' || format('{{:,}}', n) || ' rows across 5 columns', 1, 40) AS title,
  'medium' AS priority, 'Basic dataset dimensions are confirmed and ready for analysis.' AS situation,
  'Review this finding with your data team and define next steps.' AS action FROM s""",
)


def _recommendations(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_size") > 35, "high").when(F.col("p_size") > 15, "medium").otherwise("low").alias("priority"),
        F.when(F.col("p_type") == "ECONOMY", "currency").when(F.col("p_type") == "SMALL", "percentage")
        .when(F.col("p_type") == "LARGE", "categorical").otherwise("numeric_measure").alias("semantic_type"),
        (F.col("p_retailprice") / 1000).alias("confidence"),
        F.col("p_size").alias("anomalies"),
        F.when(F.col("p_size") % 3 == 0, "up").when(F.col("p_size") % 3 == 1, "down").otherwise("flat").alias("trend"),
    )


register(
    "estimated_impact",
    lambda spark, sf: scoring.estimate_impact(
        _recommendations(spark, sf), anomaly_count="anomalies", trend="trend"
    ).select("p_partkey", "min_pct", "max_pct", "label", F.round("impact_confidence", 4).alias("impact_confidence")),
    """WITH r AS (SELECT p_partkey, p_size, CASE WHEN p_size > 35 THEN 'high' WHEN p_size > 15 THEN 'medium' ELSE 'low' END AS pr,
  CASE p_type WHEN 'ECONOMY' THEN 1.5e0 WHEN 'SMALL' THEN 1.1e0 WHEN 'LARGE' THEN 0.8e0 ELSE 1.2e0 END AS f, p_retailprice / 1000 AS conf FROM part),
b AS (SELECT *, CASE pr WHEN 'high' THEN 10e0 WHEN 'medium' THEN 3e0 ELSE 1e0 END AS lo, CASE pr WHEN 'high' THEN 25e0 WHEN 'medium' THEN 10e0 ELSE 5e0 END AS hi,
  CASE pr WHEN 'high' THEN 'Significant' WHEN 'medium' THEN 'Moderate' ELSE 'Minor' END AS label FROM r),
m AS (SELECT * REPLACE (ROUND(lo * f, 1) AS lo, ROUND(hi * f, 1) AS hi) FROM b),
a AS (SELECT * REPLACE (CASE WHEN p_size > 10 THEN ROUND(lo * 1.2e0, 1) ELSE lo END AS lo, CASE WHEN p_size > 10 THEN ROUND(hi * 1.2e0, 1) ELSE hi END AS hi) FROM m)
SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN ROUND(lo * 1.1e0, 1) ELSE lo END::DOUBLE AS min_pct,
  CASE WHEN p_size % 3 = 0 THEN ROUND(hi * 1.15e0, 1) ELSE hi END::DOUBLE AS max_pct, label, ROUND(LEAST(0.9, conf), 4) AS impact_confidence FROM a""",
)
register(
    "matched_insights",
    lambda spark, sf: scoring.match_insights(
        table(spark, sf, "part").select(F.col("p_partkey").alias("position"), F.col("p_brand").alias("title")),
        table(spark, sf, "supplier").select(F.col("s_suppkey").alias("position"), F.col("s_name").alias("headline")),
    ),
    """SELECT p_partkey AS position, p_brand AS title, s_name AS headline FROM part LEFT JOIN supplier ON s_suppkey = p_partkey""",
)
register(
    "columns_with_types",
    lambda spark, sf: scoring.with_types(
        profiling.value_relation(table(spark, sf, "part"), ["p_size", "p_brand", "p_retailprice"]).groupBy("column_name").agg(
            F.count("*").alias("unique_count")
        ),
        _part_columns(spark, sf),
    ).select("column_name", "unique_count", "semantic_type", "kind"),
    """SELECT 'p_size' AS column_name, COUNT(DISTINCT p_size) AS unique_count, 'numeric_count' AS semantic_type, 'numeric' AS kind FROM part
UNION ALL SELECT 'p_brand', COUNT(DISTINCT p_brand), CASE WHEN COUNT(DISTINCT p_brand) / COUNT(*) <= 0.05 THEN 'categorical' ELSE 'free_text' END, 'text' FROM part
UNION ALL SELECT 'p_retailprice', COUNT(DISTINCT p_retailprice), 'currency', 'numeric' FROM part""",
)


def _part_columns(spark, sf):
    return profiling.profile_table(table(spark, sf, "part")).columns


def _reports(spark, sf):
    p = _profile(spark, sf)
    insights = scoring.basic_insights(p.table)
    found = anomaly.detect_anomalies(_shares(spark, sf), ["event_id"], {"value": "numeric_measure"}, forest=False)
    return scoring.report_tables(
        scoring.kpi_cards(p), insights, found, scoring.basic_recommendations(insights), key=["event_id"]
    )


register("report_kpis", lambda spark, sf: _reports(spark, sf)["kpis"], f"SELECT name AS metric, value FROM ({_KPI_SQL})")
register(
    "report_insights",
    lambda spark, sf: _reports(spark, sf)["insights"],
    f"""WITH {_FACTS}, i AS (SELECT 1 AS number, 'Dataset contains ' || format('{{:,}}', n) || ' rows across 5 columns' AS headline, 'MEDIUM' AS business_impact FROM s
UNION ALL SELECT 2, 'Data completeness is ' || printf('%.1f', complete * 100) || '%', CASE WHEN complete < 0.9 THEN 'HIGH' ELSE 'LOW' END FROM s
UNION ALL SELECT 3, format('{{:,}}', dup) || ' duplicate rows detected', 'MEDIUM' FROM s WHERE dup > 0)
SELECT *, '100%' AS confidence, '' AS source_columns FROM i""",
)
register("report_anomalies", lambda spark, sf: _reports(spark, sf)["anomalies"])
register(
    "report_anomaly_rows",
    lambda spark, sf: _reports(spark, sf)["anomalies"].drop("value", "description"),
    """WITH v AS (SELECT event_id, value / 3.7::DOUBLE AS value FROM events),
m AS (SELECT MEDIAN(value) AS med, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM v),
d AS (SELECT MEDIAN(ABS(value - med)) AS mad FROM v, m),
z AS (SELECT event_id, ABS(0.6745 * (value - med) / mad) AS z FROM v, m, d),
a AS (SELECT event_id, 'ZScore' AS method, CASE WHEN z > 5 THEN 'high' ELSE 'medium' END AS severity, ROUND(z / (z + 3.0), 4) AS confidence FROM z WHERE z >= 3.0
  UNION ALL SELECT event_id, 'IQR', 'low', 0.7 FROM v, m WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY confidence DESC,
  CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, method DESC) AS k FROM a)
SELECT 'value' AS "column", 'outlier' AS type, UPPER(severity) AS severity, event_id::VARCHAR AS row_key FROM r WHERE k = 1""",
)

register(
    "report_recommendations",
    lambda spark, sf: _reports(spark, sf)["recommendations"],
    f"""WITH {_FACTS} SELECT 'MEDIUM' AS priority, 'Address: ' || SUBSTRING('Dataset contains ' || format('{{:,}}', n) || ' rows across 5 columns', 1, 40) AS title,
  'Basic dataset dimensions are confirmed and ready for analysis.' AS situation, 'Review this finding with your data team and define next steps.' AS action FROM s""",
)
register(
    "report_forecasts",
    lambda spark, sf: _forecast_section(spark, sf),
    """WITH d AS (SELECT event_type AS series, MAX(ts)::DATE AS last FROM events GROUP BY 1)
SELECT series, STRFTIME(last + k::INTEGER, '%Y-%m-%d') AS date, TRUE AS in_band FROM d, (SELECT UNNEST(range(1, 8)) AS k)""",
)


def _forecast_section(spark, sf):
    """The forecasts of the printed report: a week a series, each inside its band."""
    daily = forecasting.daily_series(table(spark, sf, "events"), "ts", "value", ["event_type"])
    p = _profile(spark, sf)
    insights = scoring.basic_insights(p.table)
    none = anomaly.detect_anomalies(_shares(spark, sf), ["event_id"], {"value": "numeric_measure"}, forest=False)
    forecasts = forecasting.model_forecast(daily, "seasonal_trend", 30)
    sections = scoring.report_tables(
        scoring.kpi_cards(p), insights, none, scoring.basic_recommendations(insights), forecasts, key=["event_id"], max_points=7
    )
    return sections["forecasts"].select("series", F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("forecast").between(F.col("lower"), F.col("upper")).alias("in_band"))


# ── usage, metrics, lifecycle ───────────────────────────────────────────────


def _calls(spark, sf):
    return table(spark, sf, "events").select(
        F.when(F.col("event_type") == "click", "anthropic.claude-sonnet-4-5")
        .when(F.col("event_type") == "view", "anthropic.claude-haiku-4-5")
        .when(F.col("event_type") == "signup", "amazon.titan-embed-text-v2:0")
        .otherwise("unlisted").alias("model"),
        F.col("user_id").alias("session_id"),
        F.floor(F.col("value") * 100).cast("long").alias("input_tokens"),
        F.floor(F.col("value")).cast("long").alias("output_tokens"),
    )


_CALLS = """c AS (SELECT CASE event_type WHEN 'click' THEN 'anthropic.claude-sonnet-4-5' WHEN 'view' THEN 'anthropic.claude-haiku-4-5'
  WHEN 'signup' THEN 'amazon.titan-embed-text-v2:0' ELSE 'unlisted' END AS model, user_id AS session_id,
  FLOOR(value * 100)::BIGINT AS input_tokens, FLOOR(value)::BIGINT AS output_tokens FROM events),
p AS (SELECT *, (input_tokens * CASE model WHEN 'anthropic.claude-haiku-4-5' THEN 0.25 WHEN 'amazon.titan-embed-text-v2:0' THEN 0.02 ELSE 3.0 END
  + output_tokens * CASE model WHEN 'anthropic.claude-haiku-4-5' THEN 1.25 WHEN 'amazon.titan-embed-text-v2:0' THEN 0.0 ELSE 15.0 END) / 1000000 AS cost_usd FROM c)"""
_USAGE = """COUNT(*) AS call_count, SUM(input_tokens)::BIGINT AS input_tokens, SUM(output_tokens)::BIGINT AS output_tokens,
  SUM(input_tokens + output_tokens)::BIGINT AS total_tokens, ROUND(SUM(cost_usd)::DOUBLE, 4) AS cost_usd"""
register(
    "usage_by_model",
    lambda spark, sf: operations.usage_by(operations.priced_calls(_calls(spark, sf)), ["model"]).withColumn(
        "cost_usd", F.round("cost_usd", 4)
    ),
    f"WITH {_CALLS} SELECT model, {_USAGE} FROM p GROUP BY 1",
)
register(
    "usage_by_session",
    lambda spark, sf: operations.usage_by(
        operations.priced_calls(_calls(spark, sf)), ["session_id"], threshold_usd=1.0
    ).withColumn("cost_usd", F.round("cost_usd", 2)),
    f"WITH {_CALLS} SELECT session_id, {_USAGE.replace(', 4)', ', 2)')}, ROUND(SUM(cost_usd)::DOUBLE, 6) >= 1.0 AS over_threshold FROM p GROUP BY 1",
)


def _runs(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("agent"), F.col("user_id").alias("run_id"), (F.col("value") < 80).alias("success"),
        F.floor(F.col("value") * 150).cast("long").alias("duration_ms"), F.col("user_id").alias("tokens"),
        (F.col("value") / 20000).alias("cost_usd"),
    )


_RUNS = """r AS (SELECT event_type AS agent, user_id AS run_id, value < 80 AS success, FLOOR(value * 150)::BIGINT AS duration_ms,
  user_id AS tokens, value / 20000 AS cost_usd FROM events)"""
register(
    "run_metrics",
    lambda spark, sf: operations.run_metrics(_runs(spark, sf)).drop("p95_ms").withColumn("cost_usd", F.round("cost_usd", 4)),
    f"""WITH {_RUNS} SELECT agent, COUNT(*) AS runs, COUNT(*) FILTER (WHERE success) AS succeeded, COUNT(*) FILTER (WHERE NOT success) AS failed,
  SUM(duration_ms)::BIGINT AS total_ms, MAX(duration_ms) AS max_ms, SUM(tokens)::BIGINT AS total_tokens, ROUND(SUM(cost_usd), 4) AS cost_usd,
  COUNT(*) FILTER (WHERE duration_ms > 10000) AS slow_runs FROM r GROUP BY 1""",
)
_LE = "CASE " + " ".join(f"WHEN duration_ms <= {b} THEN {b}" for b in fixed.AGENT_DURATION_BUCKETS) + " END"
register(
    "duration_histogram",
    lambda spark, sf: operations.duration_histogram(_runs(spark, sf)),
    f"WITH {_RUNS} SELECT agent, success, {_LE} AS le_ms, COUNT(*) AS observations FROM r GROUP BY ALL",
)
register(
    "run_reports",
    lambda spark, sf: operations.run_reports(_runs(spark, sf)).withColumns(
        {c: F.concat_ws(",", c) for c in ("succeeded_agents", "failed_agents")}
    ).withColumn("cost_usd", F.round("cost_usd", 4)),
    f"""WITH {_RUNS}, g AS (SELECT run_id, COUNT(*) FILTER (WHERE success) AS succeeded, COUNT(*) FILTER (WHERE NOT success) AS failed,
  SUM(duration_ms)::BIGINT AS total_ms, SUM(tokens)::BIGINT AS total_tokens, ROUND(SUM(cost_usd), 6) AS cost,
  COALESCE(STRING_AGG(DISTINCT agent, ',' ORDER BY agent) FILTER (WHERE success), '') AS succeeded_agents,
  COALESCE(STRING_AGG(DISTINCT agent, ',' ORDER BY agent) FILTER (WHERE NOT success), '') AS failed_agents FROM r GROUP BY 1)
SELECT * EXCLUDE (cost), ROUND(cost, 4) AS cost_usd, CASE WHEN failed = 0 THEN 'success' WHEN succeeded > 0 THEN 'partial' ELSE 'failure' END AS status,
  cost >= 0.10 AS cost_alert FROM g""",
)


def _status_events(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id", "ts", F.col("user_id").alias("dataset_id"),
        F.when(kind == "signup", "uploaded").when(kind == "click", "profiling").when(kind == "view", "profiled")
        .when(kind == "purchase", "cleaning").otherwise("failed").alias("status"),
    )


_STATUS = """st AS (SELECT event_id, ts, user_id AS dataset_id, CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'click' THEN 'profiling'
  WHEN 'view' THEN 'profiled' WHEN 'purchase' THEN 'cleaning' ELSE 'failed' END AS status FROM events)"""
_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, b in fixed.DATASET_TRANSITIONS)
register(
    "illegal_transitions",
    lambda spark, sf: operations.illegal_transitions(
        _status_events(spark, sf), "dataset_id", "status", "ts", "event_id", initial="uploaded"
    ),
    f"""WITH {_STATUS}, l AS (SELECT dataset_id AS entity, event_id, LAG(status) OVER (PARTITION BY dataset_id ORDER BY ts, event_id) AS prev_status, status FROM st)
SELECT * FROM l WHERE (prev_status IS NULL AND status <> 'uploaded') OR (prev_status <> status AND (prev_status, status) NOT IN (VALUES {_ALLOWED}))""",
)
register(
    "latest_status",
    lambda spark, sf: operations.latest_status(_status_events(spark, sf), "dataset_id", "status", "ts", "event_id")
    .select("entity", "status", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at")),
    f"""WITH {_STATUS} SELECT dataset_id AS entity, ARG_MAX(status, (ts, event_id)) AS status, STRFTIME(MAX(ts), '%Y-%m-%d %H:%M:%S') AS updated_at
FROM st GROUP BY 1""",
)
register(
    "stale_jobs",
    lambda spark, sf: operations.stale_jobs(
        operations.latest_status(_status_events(spark, sf), "dataset_id", "status", "ts", "event_id"),
        F.lit("2024-01-30 23:59:59").cast("timestamp"),
    ),
    f"""WITH {_STATUS}, x AS (SELECT dataset_id AS entity, ARG_MAX(status, (ts, event_id)) AS status, MAX(ts) AS t FROM st GROUP BY 1)
SELECT entity, status AS stalled_in, 'failed' AS status, 'Pipeline stalled — auto-recovered by watchdog' AS reason FROM x
WHERE status IN ('profiling', 'cleaning') AND t < TIMESTAMP '2024-01-30 21:59:59'""",
)
register(
    "evaluation_summary",
    lambda spark, sf: operations.evaluation_summary(
        table(spark, sf, "events").select(
            F.col("event_type").alias("suite"), (F.col("value") > 11).alias("passed"), (F.col("value") / 500).alias("score")
        )
    ),
    """SELECT event_type AS suite, COUNT(*) AS total_cases, COUNT(*) FILTER (WHERE value > 11) AS passed, COUNT(*) FILTER (WHERE NOT value > 11) AS failed,
  ROUND(COUNT(*) FILTER (WHERE value > 11) / COUNT(*), 4) AS pass_rate, ROUND(AVG(value / 500), 4) AS avg_score,
  COUNT(*) FILTER (WHERE value > 11) / COUNT(*) >= 0.8 AS ok FROM events GROUP BY 1""",
)
register(
    "cache_hit_rate",
    lambda spark, sf: operations.cache_hit_rate(
        table(spark, sf, "events"), [F.col("event_type"), F.col("user_id").cast("string")]
    ),
    """SELECT COUNT(*) AS requests, COUNT(DISTINCT (event_type, user_id)) AS misses, COUNT(*) - COUNT(DISTINCT (event_type, user_id)) AS hits,
  ROUND((COUNT(*) - COUNT(DISTINCT (event_type, user_id))) / COUNT(*), 4) AS hit_rate FROM events""",
)
register(
    "requests_over_limit",
    lambda spark, sf: operations.requests_over_limit(table(spark, sf, "events"), "event_type", "ts", 10, 7200),
    """WITH c AS (SELECT event_type AS client, FLOOR(EPOCH(ts))::BIGINT AS second, COUNT(*) AS requests FROM events GROUP BY 1, 2),
w AS (SELECT *, (SUM(requests) OVER (PARTITION BY client ORDER BY second RANGE BETWEEN 7199 PRECEDING AND CURRENT ROW))::BIGINT AS in_window FROM c)
SELECT * FROM w WHERE in_window > 10""",
)
register(
    "idle_window_counts",
    lambda spark, sf: operations.idle_window_counts(table(spark, sf, "events"), "user_id", "ts", "6 hours"),
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER w >= INTERVAL 6 HOUR OR LAG(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id AS client, FLOOR(EPOCH(MIN(ts)))::BIGINT AS start_second, COUNT(*) AS requests FROM s GROUP BY user_id, n""",
)


def _stats_rows(spark, sf):
    found = [
        sinks.statistics_rows(profiling.profile_table(df).columns, name, "s1", "p1")
        for name, df in (("orders", _messy_orders(spark, sf)), ("parts", table(spark, sf, "part")))
    ]
    return found[0].unionByName(found[1])


_STATS_SQL = f"""t AS (SELECT * FROM {MESSY_ORDERS}),
o AS (SELECT UNNEST([COUNT(o_custkey), COUNT(order_status), COUNT(total_price), COUNT(o_orderdate), COUNT(priority)]) / ANY_VALUE(n) AS c,
  UNNEST(['numeric', 'text', 'numeric', 'datetime', 'text']) AS kind, UNNEST(['o_custkey', 'order_status', 'total_price', 'o_orderdate', 'priority']) AS column_name,
  UNNEST(['numeric_count', 'categorical', 'currency', 'datetime', 'categorical']) AS semantic_type,
  UNNEST([COUNT(DISTINCT o_custkey), COUNT(DISTINCT order_status), COUNT(DISTINCT total_price), COUNT(DISTINCT o_orderdate), COUNT(DISTINCT priority)]) AS unique_count
  FROM t, (SELECT COUNT(*) AS n FROM t)),
s AS (SELECT 'p1' AS project_id, 'orders' AS dataset_id, column_name, kind, semantic_type, unique_count, ROUND(c, 6) AS completeness, ROUND(1 - c, 6) AS null_rate FROM o
UNION ALL SELECT 'p1', 'parts', '', UNNEST(['numeric', 'text', 'text', 'text', 'numeric', 'numeric']), '', 0, 1.0, 0.0)"""
register(
    "dataset_summary",
    lambda spark, sf: operations.dataset_summary(_stats_rows(spark, sf)),
    f"""WITH {_STATS_SQL} SELECT dataset_id, ROUND(AVG(completeness), 4) AS avg_completeness, ROUND(AVG(null_rate), 4) AS avg_null_rate, COUNT(*) AS column_count,
  COUNT(*) FILTER (WHERE kind = 'numeric') AS numeric_column_count FROM s GROUP BY 1""",
)
register(
    "project_benchmark",
    lambda spark, sf: operations.project_benchmark(_stats_rows(spark, sf)),
    f"""WITH {_STATS_SQL} SELECT project_id, ROUND(AVG(completeness), 4) AS project_avg_completeness, ROUND(MIN(completeness), 4) AS project_min_completeness,
  ROUND(MAX(completeness), 4) AS project_max_completeness, COUNT(DISTINCT dataset_id) AS dataset_count FROM s GROUP BY 1""",
)
register(
    "compared_to_project",
    lambda spark, sf: operations.compared_to_project(_stats_rows(spark, sf)),
    f"""WITH {_STATS_SQL} SELECT project_id, dataset_id, ROUND(AVG(completeness) - (SELECT AVG(completeness) FROM s), 4) AS difference FROM s GROUP BY 1, 2""",
)
register(
    "high_null_columns",
    lambda spark, sf: operations.high_null_columns(_stats_rows(spark, sf), 0.20),
    f"WITH {_STATS_SQL} SELECT dataset_id, column_name, null_rate, semantic_type, unique_count FROM s WHERE null_rate > 0.2",
)
register(
    "stored_statistics",
    lambda spark, sf: _stored_statistics(spark, sf),
    f"WITH {_STATS_SQL} SELECT dataset_id, kind, COUNT(*) AS columns FROM s WHERE dataset_id <> 'parts' GROUP BY 1, 2",
)


def _stored_statistics(spark, sf):
    """Written to the monthly table, one dataset removed again, read back."""
    folder = new_folder(spark, "statistics")
    sinks.append_statistics(_stats_rows(spark, sf), folder)
    sinks.delete_dataset(spark, folder, "parts")
    return sinks.read_statistics(spark, folder).groupBy("dataset_id", "kind").agg(F.count("*").alias("columns"))


# ── files and keys ──────────────────────────────────────────────────────────


#: Rows of a landed file, at most about: of long texts, and of narrow rows.
TEXT_ROWS, NARROW_ROWS = 20_000, 500_000


def _landed(df, key, folder, form, rows=NARROW_ROWS, **options):
    """One file per key value, below a folder named after it; a value of more than ``rows`` rows has several, by a hash of the row, each from a task of its own."""
    counted = df.groupBy(key).agg(F.ceil(F.count("*") / rows).alias("_files"))
    size = counted.agg(F.sum("_files").alias("files"), F.count("*").alias("keys")).first()
    if size.keys and size.files > size.keys:
        dealt = columns.join_null_safe(df, F.broadcast(counted), [key]).withColumn("_file", F.pmod(F.xxhash64(*df.columns), F.col("_files")))
        dealt = dealt.repartition(4 * size.files, key, "_file").select(*df.columns)
    else:
        dealt = df.repartition(key)
    dealt.write.mode("append").partitionBy(key).format(form).options(**options).save(folder)


def _landing_catalog(spark, sf):
    """Documents and orders written in several layouts, a folder per language or priority, and catalogued from samples of the files; a row per folder and write.

    Of a write's files few may show letters beyond ASCII; one that is Latin-1 makes the others so.
    """
    folder = new_folder(spark, "landing")
    # few letters of the English texts are beyond ASCII, so that samples may miss them; without them the answer is one
    plain = F.when(F.col("lang") == "en", F.regexp_replace("text", r"[^\x00-\x7F]", "")).otherwise(F.col("text"))
    docs = table(spark, sf, "documents").select("doc_id", plain.alias("text"), "n_chars", F.concat("lang", F.lit("-latin")).alias("kind"))
    _landed(docs, "kind", f"{folder}/csv", "csv", TEXT_ROWS, header=True, encoding="ISO-8859-1", quoteAll=True, escape='"')
    _landed(docs.withColumn("kind", F.regexp_replace("kind", "latin", "utf")), "kind", f"{folder}/csv", "csv", TEXT_ROWS, header=True, quoteAll=True, escape='"')
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderpriority").substr(1, 1).alias("kind"))
    _landed(orders, "kind", f"{folder}/rows", "csv", header=True, sep=";")
    _landed(orders, "kind", f"{folder}/lines", "json")
    _landed(orders, "kind", f"{folder}/columns", "parquet")
    place = F.regexp_extract("path", r"/(csv|rows|lines|columns)/kind=([^/]+)/", 1)
    found = files.catalog_files(spark, folder).select(
        place.alias("place"), F.regexp_extract("path", r"/kind=([^/]+)/", 1).alias("kind"), "format", "encoding",
        F.when(place == "rows", F.col("delimiter")).alias("delimiter"), "has_quotes", "is_newline_json",
        F.regexp_extract("path", r"/part-\d+-([0-9a-f-]{36})[^/]*$", 1).alias("_write"),  # Spark names a write's files after it
    )
    layout = [c for c in found.columns if c not in ("encoding", "_write")]
    return found.groupBy("_write", *layout).agg(F.min("encoding").alias("encoding")).select(*[c for c in found.columns if c != "_write"])


register(
    "landing_catalog",
    _landing_catalog,
    """WITH langs AS (SELECT lang, lang <> 'en' AS wide FROM documents GROUP BY lang),
kinds AS (SELECT DISTINCT substr(o_orderpriority, 1, 1) AS kind FROM orders)
SELECT 'csv' AS place, lang || '-latin' AS kind, 'csv' AS format, CASE WHEN wide THEN 'latin-1' ELSE 'utf-8' END AS encoding,
  NULL AS delimiter, TRUE AS has_quotes, FALSE AS is_newline_json FROM langs
UNION ALL SELECT 'csv', lang || '-utf', 'csv', 'utf-8', NULL, TRUE, FALSE FROM langs
UNION ALL SELECT 'rows', kind, 'csv', 'utf-8', ';', FALSE, FALSE FROM kinds
UNION ALL SELECT 'lines', kind, 'json', 'utf-8', NULL, FALSE, FALSE FROM kinds
UNION ALL SELECT 'columns', kind, 'parquet', 'utf-8', NULL, FALSE, FALSE FROM kinds""",
)


def _upload_checks(spark, sf):
    """A file per nation that holds its region's row, so that nations of a region are copies, and one of an unknown kind per region."""
    folder = new_folder(spark, "uploads")
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    _landed(nations.select("r_regionkey", "r_name", F.col("n_nationkey").alias("key")), "key", f"{folder}/rows", "csv", header=True)
    _landed(nations.select(F.col("n_name").alias("value"), F.col("n_regionkey").alias("key")).groupBy("key").agg(F.min("value").alias("value")), "key", f"{folder}/odd", "text", compression="gzip")
    known = table(spark, sf, "region").where("r_regionkey = 0").select(
        F.sha2(F.concat_ws("\n", F.lit("r_regionkey,r_name"), F.concat_ws(",", "r_regionkey", "r_name"), F.lit("")), 256).alias("checksum")
    )
    checked = files.check_uploads(spark, folder, known)
    kind = F.regexp_extract("path", r"/(rows|odd)/key=(\d+)/", 1)
    return checked.select(
        kind.alias("kind"), F.regexp_extract("path", r"/key=(\d+)/", 1).cast("int").alias("key"),
        F.when(kind == "rows", F.col("length")).alias("length"), F.when(kind == "rows", F.col("checksum")).alias("checksum"), "reject_reason", "accepted",
    )


register(
    "upload_checks",
    _upload_checks,
    """WITH files AS (SELECT n_nationkey AS key, r_regionkey, 'r_regionkey,r_name' || chr(10) || r_regionkey || ',' || r_name || chr(10) AS content
  FROM nation JOIN region ON n_regionkey = r_regionkey),
judged AS (SELECT *, r_regionkey = 0 OR row_number() OVER (PARTITION BY content ORDER BY key || '/') > 1 AS again FROM files)
SELECT 'rows' AS kind, CAST(key AS INTEGER) AS key, CAST(length(content) AS BIGINT) AS length, sha256(content) AS checksum,
  CASE WHEN again THEN 'duplicate' END AS reject_reason, NOT again AS accepted FROM judged
UNION ALL SELECT DISTINCT 'odd', CAST(n_regionkey AS INTEGER), NULL::BIGINT, NULL, 'unsupported', FALSE FROM nation""",
)


def _late_quotes(spark, sf):
    """Documents written with their line breaks inside quotes, Latin-1 and UTF-8 side by side, and read back without being told so."""
    folder = new_folder(spark, "quoted")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    latin, first = F.col("lang") == "fr", F.col("doc_id") % 2 == 0
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    fits = ~F.col("text").rlike("[^\\x00-\\xFF]")
    docs.where(latin & fits).write.options(**options).csv(f"{folder}/latin", encoding="ISO-8859-1")
    docs.where(~(latin & fits)).orderBy(first, "doc_id").write.options(**options).csv(f"{folder}/utf")
    return files.load_dataset(spark, folder, "csv").select("doc_id", "lang", F.md5("text").alias("text_md5"))


register("csv_quoted_round_trip", _late_quotes, "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents")


def _round_trip(spark, sf):
    """Customers written as CSV with missing-value texts, read back with the null tokens."""
    folder = new_folder(spark, "csv")
    table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") == "MACHINERY", "N/A").otherwise(F.col("c_mktsegment")).alias("segment"),
        "c_acctbal",
    ).write.option("header", True).csv(folder)
    return files.load_dataset(spark, folder, "csv")


register(
    "csv_round_trip",
    _round_trip,
    "SELECT c_custkey, NULLIF(c_mktsegment, 'MACHINERY') AS segment, c_acctbal FROM customer",
)


def _json_round_trip(spark, sf):
    folder = new_folder(spark, "json")
    sinks.write_json(table(spark, sf, "nation"), folder)
    return files.load_dataset(spark, folder, "json")


register("json_round_trip", _json_round_trip, "SELECT n_nationkey, n_name, n_regionkey FROM nation")
register(
    "described_columns",
    lambda spark, sf: _describe(table(spark, sf, "supplier")),
    """SELECT column_name, CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE LOWER(data_type) END AS column_type
FROM (DESCRIBE supplier) AS d(column_name, data_type, a, b, c, e)""",
)


def _describe(df):
    from ..operators.selecting import describe

    return describe(df).select("column_name", "column_type")


register(
    "content_keys",
    lambda spark, sf: table(spark, sf, "documents").select(
        "doc_id",
        columns.prompt_key(F.col("source"), F.col("text")).alias("prompt_key"),
        columns.chunk_key(F.col("source"), F.col("doc_id")).alias("chunk_key"),
        columns.short_hash(F.col("text"), 12).alias("short_hash"),
        F.sha2(columns.canonical_json({"n_chars": F.col("n_chars"), "lang": F.col("lang")}), 256).alias("record_key"),
    ),
    """SELECT doc_id, SHA256(source || ':' || text) AS prompt_key, SHA256(source || ':chunk:' || doc_id) AS chunk_key,
  SUBSTRING(SHA256(text), 1, 12) AS short_hash, SHA256('{"lang": "' || lang || '", "n_chars": ' || n_chars || '}') AS record_key FROM documents""",
)
register(
    "audit_records",
    lambda spark, sf: sinks.audit_records(
        table(spark, sf, "pages").select(
            F.lit("dataset.uploaded").alias("event_type"), F.col("url").alias("filename"),
            F.col("page_id").cast("string").alias("dataset_id"), F.length("html").alias("size_bytes"), F.lit(None).cast("string").alias("user_id"),
        )
    ).select("event_type", F.get_json_object("record", "$.dataset_id").alias("dataset_id"),
             F.get_json_object("record", "$.filename_hash").alias("filename_hash"),
             F.contains(F.col("record"), F.lit("user_id")).alias("has_user")),
    """SELECT 'dataset.uploaded' AS event_type, page_id::VARCHAR AS dataset_id, SUBSTRING(SHA256(url), 1, 16) AS filename_hash, FALSE AS has_user FROM pages""",
)

# ── streams ─────────────────────────────────────────────────────────────────

register(
    "stream_profile",
    lambda spark, sf: streams.run_profile(spark, sf, "events", ["value", "user_id"]).select(
        "column_name", "row_count", "non_null_count", F.round("mean", 4).alias("mean"), "min_val", "max_val",
        F.round("stddev", 4).alias("stddev"),
    ),
    """SELECT 'value' AS column_name, COUNT(*) AS row_count, COUNT(value) AS non_null_count, ROUND(AVG(value), 4) AS mean, MIN(value) AS min_val,
  MAX(value) AS max_val, ROUND(STDDEV_SAMP(value), 4) AS stddev FROM events
UNION ALL SELECT 'user_id', COUNT(*), COUNT(user_id), ROUND(AVG(user_id), 4), MIN(user_id), MAX(user_id), ROUND(STDDEV_SAMP(user_id), 4) FROM events""",
)
register(
    "stream_rate_windows",
    lambda spark, sf: streams.run_rate_windows(spark, sf, "1 hour", 4).select(
        "client", F.unix_seconds("window_start").alias("window_second"), "requests", "over_limit"
    ),
    """SELECT event_type AS client, (FLOOR(EPOCH(ts) / 3600) * 3600)::BIGINT AS window_second, COUNT(*) AS requests, COUNT(*) > 4 AS over_limit
FROM events GROUP BY 1, 2""",
)
register(
    "stream_latest_status",
    lambda spark, sf: streams.run_latest_status(spark, sf),
    f"""WITH {_STATUS} SELECT dataset_id, ARG_MAX(status, (ts, event_id)) AS status FROM st GROUP BY 1""",
)
register(
    "stream_requests_over_limit",
    lambda spark, sf: stateful.run_sliding_counts(spark, sf, 10, 7200),
    """WITH c AS (SELECT event_type AS client, FLOOR(EPOCH(ts))::BIGINT AS second, COUNT(*) AS requests FROM events GROUP BY 1, 2),
w AS (SELECT *, (SUM(requests) OVER (PARTITION BY client ORDER BY second RANGE BETWEEN 7199 PRECEDING AND CURRENT ROW))::BIGINT AS in_window FROM c)
SELECT * FROM w WHERE in_window > 10""",
)
register(
    "stream_tracked_jobs",
    lambda spark, sf: stateful.run_tracked_jobs(spark, sf).select("kind", "entity", "status", F.unix_micros("at").alias("at_micros")),
    f"""WITH {_STATUS}, n AS (SELECT dataset_id::VARCHAR AS entity, status, ts, EPOCH_US(LEAD(ts) OVER (PARTITION BY dataset_id ORDER BY ts, event_id)) - EPOCH_US(ts) AS gap FROM st)
SELECT 'status' AS kind, entity, status, EPOCH_US(ts) AS at_micros FROM n
UNION ALL SELECT 'stalled', entity, status, EPOCH_US(ts) FROM n WHERE status IN ('profiling', 'cleaning') AND COALESCE(gap > 7200000000, TRUE)
UNION ALL SELECT 'expired', entity, status, EPOCH_US(ts) FROM n WHERE COALESCE(gap > 86400000000, TRUE)""",
)


def _stalled_now(spark, sf):
    """The alarms of the stream that still stand: those of an entity's last status, as the batch watchdog lists them."""
    rows = stateful.run_tracked_jobs(spark, sf, keep_hours=24.0 * 60)
    last = rows.where("kind = 'status'").groupBy("entity").agg(F.max("at").alias("at"))
    alarms = rows.where("kind = 'stalled'").join(last, ["entity", "at"]).where(F.col("at") < F.lit("2024-01-30 21:59:59").cast("timestamp"))
    return alarms.select(F.col("entity").cast("long").alias("entity"), F.col("status").alias("stalled_in"))


register(
    "stream_stalled_jobs",
    _stalled_now,
    f"""WITH {_STATUS}, x AS (SELECT dataset_id AS entity, ARG_MAX(status, (ts, event_id)) AS status, MAX(ts) AS t FROM st GROUP BY 1)
SELECT entity, status AS stalled_in FROM x WHERE status IN ('profiling', 'cleaning') AND t < TIMESTAMP '2024-01-30 21:59:59'""",
)
register(
    "stream_two_consumers",
    lambda spark, sf: streams.run_two_consumers(spark, sf).groupBy("consumer", "event_type").agg(F.count_distinct("event_id").alias("events")),
    "SELECT consumer, event_type, COUNT(*) AS events FROM events, (SELECT UNNEST(['notify', 'index']) AS consumer) GROUP BY ALL",
)
register(
    "stream_deduplicated",
    lambda spark, sf: streams.run_deduplicated(spark, sf).groupBy("event_type").agg(F.count("*").alias("events")),
    "SELECT event_type, COUNT(*) AS events FROM events GROUP BY 1",
)
register(
    "stream_routed",
    lambda spark, sf: streams.run_routed(spark, sf).groupBy("topic").agg(
        F.count("*").alias("events"), F.count_distinct("partition_key").alias("keys")
    ),
    """SELECT CASE event_type WHEN 'signup' THEN 'dataset.uploaded' WHEN 'click' THEN 'analytics.profiling-complete'
  WHEN 'view' THEN 'analytics.cleaning-complete' WHEN 'purchase' THEN 'chat.message' END AS topic, COUNT(*) AS events, COUNT(DISTINCT user_id) AS keys
FROM events WHERE event_type <> 'error' GROUP BY 1""",
)
register(
    "stream_decoded",
    lambda spark, sf: streams.run_decoded(spark, sf),
    """SELECT CASE WHEN event_type = 'error' THEN 'dead letter' ELSE 'accepted' END AS outcome, COUNT(*) AS events FROM events GROUP BY 1""",
)
register(
    "stream_triggered_jobs",
    lambda spark, sf: streams.run_triggered(spark, sf),
    """SELECT user_id::VARCHAR AS dataset_id, COUNT(*) AS triggers FROM events WHERE event_type = 'view' AND user_id >= 50 GROUP BY 1""",
)
register(
    "stream_metrics",
    lambda spark, sf: streams.run_metrics_windows(spark, sf).select(
        "agent", F.unix_seconds("window_start").alias("window_second"), "runs", "slow_runs"
    ),
    """SELECT event_type AS agent, (FLOOR(EPOCH(ts) / 15) * 15)::BIGINT AS window_second, COUNT(*) AS runs,
  COUNT(*) FILTER (WHERE value * 150 > 10000) AS slow_runs FROM events GROUP BY 1, 2""",
)
