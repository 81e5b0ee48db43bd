"""Registered queries: statistics, distributions, relations, time series, selecting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiling, relations, selecting, sketches, statistics, timeseries
from ..session import cut_lineage, new_folder, spread
from .tables import rounded, table

QUERIES, ORACLES = {}, {}


def register(name, run, sql=None):
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def union(parts):
    return "\nUNION ALL\n".join(parts)


# ── column statistics ───────────────────────────────────────────────────────

_STATS_ROUNDED = [
    "mean", "median", "stddev", "min_val", "max_val", "range_val", "p5", "p25", "p50", "p75", "p95", "iqr",
    "tukey_lower_fence", "tukey_upper_fence", "skewness", "kurtosis",
]


def _stats_sql(source, column):
    q = lambda p: f"quantile_cont({column}::DOUBLE, {p})"
    return f"""SELECT '{column}' AS column_name, COUNT(*) AS total_rows, COUNT({column}) AS non_null_count,
  COUNT(*) - COUNT({column}) AS null_count,
  ROUND((COUNT(*) - COUNT({column}))::DOUBLE / COUNT(*), 6) AS null_rate,
  COUNT(DISTINCT {column}) AS unique_count,
  ROUND(COUNT(DISTINCT {column})::DOUBLE / NULLIF(COUNT({column}), 0), 6) AS cardinality_ratio,
  ROUND(AVG({column}::DOUBLE), 4) AS mean, ROUND(MEDIAN({column}::DOUBLE), 4) AS median,
  ROUND(STDDEV_POP({column}::DOUBLE), 4) AS stddev, ROUND(SQRT(VAR_POP({column}::DOUBLE)), 4) AS variance_root,
  ROUND(MIN({column}::DOUBLE), 4) AS min_val, ROUND(MAX({column}::DOUBLE), 4) AS max_val,
  ROUND(MAX({column}::DOUBLE) - MIN({column}::DOUBLE), 4) AS range_val,
  ROUND(SUM({column}::DOUBLE) / 1000000, 4) AS total_sum_millions,
  ROUND({q(0.05)}, 4) AS p5, ROUND({q(0.25)}, 4) AS p25, ROUND({q(0.5)}, 4) AS p50,
  ROUND({q(0.75)}, 4) AS p75, ROUND({q(0.95)}, 4) AS p95,
  ROUND({q(0.75)} - {q(0.25)}, 4) AS iqr,
  ROUND({q(0.25)} - 1.5 * ({q(0.75)} - {q(0.25)}), 4) AS tukey_lower_fence,
  ROUND({q(0.75)} + 1.5 * ({q(0.75)} - {q(0.25)}), 4) AS tukey_upper_fence,
  ROUND(SKEWNESS({column}::DOUBLE), 4) AS skewness, ROUND(KURTOSIS({column}::DOUBLE), 4) AS kurtosis,
  ROUND(STDDEV_POP({column}::DOUBLE) / NULLIF(ABS(AVG({column}::DOUBLE)), 0), 6) AS coefficient_of_variation,
  COUNT(*) FILTER (WHERE {column}::DOUBLE = 0) AS zero_count,
  COUNT(*) FILTER (WHERE {column}::DOUBLE < 0) AS negative_count
FROM {source}"""


def _column_statistics(df, columns):
    out = statistics.column_statistics(df, columns)
    out = rounded(out, _STATS_ROUNDED).withColumns(
        {
            "variance_root": F.round(F.sqrt("variance"), 4),
            "total_sum_millions": F.round(F.col("total_sum") / 1_000_000, 4),
        }
    )
    return out.drop("variance", "total_sum", "computed_at")


register(
    "column_statistics",
    lambda spark, sf: _column_statistics(table(spark, sf, "lineitem"), LINE_NUMBERS),
    union(_stats_sql("lineitem", c) for c in LINE_NUMBERS),
)


def _sparse_lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_quantity",
        F.nullif("l_discount", F.lit(0.0)).alias("discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("tax"),
    )


SPARSE_LINES = "(SELECT l_quantity, NULLIF(l_discount, 0) AS discount, NULLIF(l_tax, 0) AS tax FROM lineitem)"

register(
    "column_statistics_with_nulls",
    lambda spark, sf: _column_statistics(_sparse_lines(spark, sf), ["discount", "tax"]),
    union(_stats_sql(SPARSE_LINES, c) for c in ("discount", "tax")),
)

register(
    "distinct_counts",
    lambda spark, sf: statistics.distinct_counts(
        table(spark, sf, "orders"), ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
    ),
    union(
        f"SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS unique_count FROM orders"
        for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    ),
)

# ── distributions ───────────────────────────────────────────────────────────

_DISTRIBUTION_SQL = """SELECT value, frequency, ROUND(frequency::DOUBLE / total, 6) AS relative_frequency,
  ROUND(100.0 * frequency::DOUBLE / total, 2) AS percentage, cumulative_count,
  ROUND(100.0 * cumulative_count::DOUBLE / total, 2) AS cumulative_pct, frequency_rank
FROM (
  SELECT {column}::VARCHAR AS value, COUNT(*) AS frequency,
    (SUM(COUNT(*)) OVER ())::BIGINT AS total,
    (SUM(COUNT(*)) OVER (ORDER BY COUNT(*) DESC, {column}::VARCHAR ROWS UNBOUNDED PRECEDING))::BIGINT AS cumulative_count,
    RANK() OVER (ORDER BY COUNT(*) DESC) AS frequency_rank
  FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}
) ORDER BY frequency DESC, value LIMIT 20"""

register(
    "value_distribution",
    lambda spark, sf: statistics.value_distribution(table(spark, sf, "part"), "p_brand"),
    _DISTRIBUTION_SQL.format(table="part", column="p_brand"),
)
register(
    "value_distribution_numbers",
    lambda spark, sf: statistics.value_distribution(table(spark, sf, "lineitem"), "l_linenumber"),
    _DISTRIBUTION_SQL.format(table="lineitem", column="l_linenumber"),
)

TOP_COLUMNS = [("l_returnflag", "lineitem"), ("l_linestatus", "lineitem"), ("l_suppkey", "lineitem")]
register(
    "top_values",
    lambda spark, sf: statistics.top_value_counts(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_suppkey"]
    ),
    f"""WITH counted AS ({union(f"SELECT '{c}' AS column_name, {c}::VARCHAR AS value, COUNT(*) AS count FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}" for c, t in TOP_COLUMNS)}),
ranked AS (SELECT *, SUM(count) OVER (PARTITION BY column_name) AS total,
  ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS rank FROM counted)
SELECT column_name, value, count, ROUND(count / total, 6) AS pct,
  ROUND(count / SUM(count) OVER (PARTITION BY column_name), 6) AS pct_of_top, rank
FROM ranked WHERE rank <= 20""",
)


def _histogram_sql(source, column, bins):
    return f"""SELECT '{column}' AS column_name, s.bin_index, ROUND(lo + s.bin_index * width, 4) AS bin_start,
  ROUND(lo + (s.bin_index + 1) * width, 4) AS bin_end, COALESCE(c.frequency, 0) AS frequency,
  ROUND(COALESCE(c.frequency, 0)::DOUBLE / n, 6) AS relative_frequency,
  ROUND(100.0 * COALESCE(c.frequency, 0)::DOUBLE / n, 2) AS percentage
FROM (SELECT MIN({column})::DOUBLE AS lo, COUNT({column}) AS n, {bins} AS k,
        (MAX({column})::DOUBLE - MIN({column})::DOUBLE) / {bins} AS width FROM {source}) b
CROSS JOIN (SELECT UNNEST(range(20))::INTEGER AS bin_index) s
LEFT JOIN (
  SELECT LEAST(FLOOR(({column}::DOUBLE - lo) / width), k - 1)::INTEGER AS bin_index, COUNT(*) AS frequency
  FROM {source} CROSS JOIN (SELECT MIN({column})::DOUBLE AS lo, {bins} AS k,
     (MAX({column})::DOUBLE - MIN({column})::DOUBLE) / {bins} AS width FROM {source})
  WHERE {column} IS NOT NULL GROUP BY 1) c ON c.bin_index = s.bin_index
WHERE s.bin_index < b.k"""


register(
    "histogram",
    lambda spark, sf: rounded(
        statistics.histogram(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"]),
        ["bin_start", "bin_end"],
    ),
    union(_histogram_sql("lineitem", c, "20") for c in ("l_extendedprice", "l_quantity")),
)
_AUTO = "(LEAST(20, GREATEST(5, COUNT(DISTINCT {c}))))"
register(
    "histogram_auto_bins",
    lambda spark, sf: rounded(
        statistics.histogram(table(spark, sf, "lineitem"), ["l_linenumber", "l_discount"], bins=None),
        ["bin_start", "bin_end"],
    ),
    union(_histogram_sql("lineitem", c, _AUTO.format(c=c)) for c in ("l_linenumber", "l_discount")),
)

ENTROPY_COLUMNS = [("l_returnflag", "lineitem"), ("l_linenumber", "lineitem"), ("l_suppkey", "lineitem")]
register(
    "entropy",
    lambda spark, sf: statistics.entropy(
        table(spark, sf, "lineitem"), [c for c, _ in ENTROPY_COLUMNS]
    ),
    f"""WITH counted AS ({union(f"SELECT '{c}' AS column_name, {c}::VARCHAR AS value, COUNT(*) AS n FROM {t} GROUP BY {c}" for c, t in ENTROPY_COLUMNS)}),
shared AS (SELECT *, n / SUM(n) OVER (PARTITION BY column_name) AS p,
   ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS r FROM counted)
SELECT column_name, COUNT(*) AS categories, ROUND(-SUM(p * LOG2(p)), 6) AS entropy,
  ROUND(CASE WHEN COUNT(*) <= 1 THEN 0.0 ELSE -SUM(p * LOG2(p)) / LOG2(COUNT(*)) END, 6) AS normalised_entropy,
  ROUND(SUM(p) FILTER (WHERE r <= 3), 6) AS top3_coverage
FROM shared GROUP BY column_name""",
)
register(
    "gini",
    lambda spark, sf: statistics.gini(table(spark, sf, "orders"), "o_totalprice"),
    """SELECT 'o_totalprice' AS column_name, COUNT(*) AS n,
  ROUND(SUM((2 * i - n - 1) * (v / 1000.0)) / (MAX(n) * SUM(v / 1000.0)), 6) AS gini
FROM (SELECT ABS(o_totalprice) AS v, ROW_NUMBER() OVER (ORDER BY ABS(o_totalprice)) AS i,
        COUNT(*) OVER () AS n FROM orders)""",
)


def _outlier_sql(source, column):
    q = lambda p: f"quantile_cont({column}, {p})"
    return f"""SELECT '{column}' AS column_name, ROUND(iqr, 4) AS iqr, ROUND(lo, 4) AS tukey_lower,
  ROUND(hi, 4) AS tukey_upper, COUNT(*) FILTER (WHERE {column} < lo OR {column} > hi) AS outlier_count_iqr
FROM {source} CROSS JOIN (SELECT {q(0.75)} - {q(0.25)} AS iqr,
  ROUND({q(0.25)} - 1.5 * ({q(0.75)} - {q(0.25)}), 6) AS lo,
  ROUND({q(0.75)} + 1.5 * ({q(0.75)} - {q(0.25)}), 6) AS hi FROM {source})
GROUP BY iqr, lo, hi"""


def _with_unit_price(spark, sf):
    return table(spark, sf, "lineitem").withColumn(
        "unit_price", F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2)
    )


UNIT_PRICE = "(SELECT *, ROUND(l_extendedprice / l_quantity, 2) AS unit_price FROM lineitem)"

register(
    "outlier_counts",
    lambda spark, sf: rounded(
        statistics.outlier_counts(_with_unit_price(spark, sf), ["unit_price", "l_quantity"]),
        ["iqr", "tukey_lower", "tukey_upper"],
    ),
    union([_outlier_sql(UNIT_PRICE, "unit_price"), _outlier_sql("lineitem", "l_quantity")]),
)

# ── relations between columns ───────────────────────────────────────────────

_PAIRS = [(a, b) for i, a in enumerate(sorted(LINE_NUMBERS)) for b in sorted(LINE_NUMBERS)[i + 1 :]]
_R = "CORR({a}::DOUBLE, {b}::DOUBLE)"
register(
    "correlation_matrix",
    lambda spark, sf: rounded(
        relations.correlation_matrix(table(spark, sf, "lineitem"), LINE_NUMBERS, min_abs_r=0.0), ["r", "r_squared", "abs_r"]
    ),
    f"""SELECT col_a, col_b, ROUND(ROUND(r, 6), 4) AS r, ROUND(ROUND(r * r, 6), 4) AS r_squared,
  CASE WHEN ABS(r) >= 0.9 THEN 'very_strong' WHEN ABS(r) >= 0.7 THEN 'strong' WHEN ABS(r) >= 0.5 THEN 'moderate'
       WHEN ABS(r) >= 0.3 THEN 'weak' ELSE 'negligible' END AS strength,
  CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, ROUND(ABS(r), 4) AS abs_r,
  FALSE AS is_mirror, RANK() OVER (ORDER BY ABS(r) DESC) AS strength_rank
FROM ({union(f"SELECT '{a}' AS col_a, '{b}' AS col_b, CORR({a}::DOUBLE, {b}::DOUBLE) AS r FROM lineitem" for a, b in _PAIRS)})
WHERE r IS NOT NULL""",
)
register(
    "correlations",
    lambda spark, sf: relations.correlations(
        table(spark, sf, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount"))),
        ["l_quantity", "l_extendedprice", "l_discount", "net"],
    ).withColumn("r", F.round("r", 4)),
    """WITH t AS (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem),
p AS (
  SELECT 'l_discount' AS col_a, 'l_extendedprice' AS col_b, CORR(l_discount, l_extendedprice) AS r, COUNT(*) AS n FROM t
  UNION ALL SELECT 'l_discount', 'l_quantity', CORR(l_discount, l_quantity), COUNT(*) FROM t
  UNION ALL SELECT 'l_discount', 'net', CORR(l_discount, net), COUNT(*) FROM t
  UNION ALL SELECT 'l_extendedprice', 'l_quantity', CORR(l_extendedprice, l_quantity), COUNT(*) FROM t
  UNION ALL SELECT 'l_extendedprice', 'net', CORR(l_extendedprice, net), COUNT(*) FROM t
  UNION ALL SELECT 'l_quantity', 'net', CORR(l_quantity, net), COUNT(*) FROM t)
SELECT col_a, col_b, ROUND(ROUND(r, 6), 4) AS r, n AS sample_size,
  CASE WHEN ABS(r) >= 0.9 THEN 'very_strong' WHEN ABS(r) >= 0.7 THEN 'strong' WHEN ABS(r) >= 0.5 THEN 'moderate'
       WHEN ABS(r) >= 0.3 THEN 'weak' ELSE 'negligible' END AS strength,
  CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM p WHERE ABS(r) >= 0.3""",
)
register(
    "correlations_pairwise_nulls",
    lambda spark, sf: relations.pair_correlations(
        _sparse_lines(spark, sf), ["l_quantity", "discount", "tax"]
    ).withColumn("r", F.round("r", 4)),
    "\nUNION ALL\n".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, ROUND(CORR({a}, {b}), 4) AS r, REGR_COUNT({a}, {b})::BIGINT AS n FROM {SPARSE_LINES}"
        for a, b in (("discount", "l_quantity"), ("discount", "tax"), ("l_quantity", "tax"))
    ),
)
register(
    "spearman_correlations",
    lambda spark, sf: relations.spearman(table(spark, sf, "lineitem"), LINE_NUMBERS).withColumn("r", F.round("r", 4)),
    f"""WITH ranked AS (SELECT {", ".join(f"RANK() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in LINE_NUMBERS)} FROM lineitem)
{union(f"SELECT '{a}' AS col_a, '{b}' AS col_b, ROUND(CORR({a}::DOUBLE, {b}::DOUBLE), 4) AS r, COUNT(*) AS n FROM ranked" for a, b in _PAIRS)}""",
)

_TREND_SQL = """WITH p AS (SELECT {keys}datediff('day', DATE '1970-01-01', {ts}::DATE)::DOUBLE AS x, {value}::DOUBLE AS y FROM {table}),
f AS (SELECT {keys}REGR_SLOPE(y, x) AS b, REGR_INTERCEPT(y, x) AS a, REGR_R2(y, x) AS r2, MIN(x) AS x0, MAX(x) AS x1,
        COUNT(*) AS n FROM p {group})
SELECT {keys}ROUND(ROUND(b, 8), 6) AS slope, ROUND(ROUND(r2, 6), 4) AS r_squared,
  CASE WHEN b > 0 THEN 'increasing' WHEN b < 0 THEN 'decreasing' ELSE 'flat' END AS direction,
  ROUND((a + b * x1 - (a + b * x0)) / ABS(a + b * x0) * 100, 2) AS pct_change, n AS data_points, r2 > 0.5 AS is_significant
FROM f"""


def _trend(df, ts, value, by=()):
    out = relations.linear_trend(df, ts, value, by)
    return out.withColumns({"slope": F.round("slope", 6), "r_squared": F.round("r_squared", 4)})


register(
    "linear_trend",
    lambda spark, sf: _trend(table(spark, sf, "orders"), "o_orderdate", "o_totalprice"),
    _TREND_SQL.format(keys="", ts="o_orderdate", value="o_totalprice", table="orders", group=""),
)
register(
    "linear_trend_by_series",
    lambda spark, sf: _trend(table(spark, sf, "events"), "ts", "value", ["event_type"]),
    _TREND_SQL.format(keys="event_type, ", ts="ts", value="value", table="events", group="GROUP BY event_type"),
)
register(
    "welch_t_test",
    lambda spark, sf: relations.welch_t_test(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag")
    .select("test", F.round("t_statistic", 4).alias("t_statistic"), F.round("dof", 2).alias("dof"),
            F.col("groups")[0].alias("group_a"), F.col("groups")[1].alias("group_b")),
    """WITH g AS (SELECT l_returnflag AS g, AVG(l_extendedprice) AS m, VAR_SAMP(l_extendedprice) AS v, COUNT(*) AS n,
   ROW_NUMBER() OVER (ORDER BY l_returnflag) AS r FROM lineitem GROUP BY 1),
a AS (SELECT * FROM g WHERE r = 1), b AS (SELECT * FROM g WHERE r = 2)
SELECT 'Welch''s t-test' AS test, ROUND(ROUND((a.m - b.m) / SQRT(a.v / a.n + b.v / b.n), 6), 4) AS t_statistic,
  ROUND(POWER(a.v / a.n + b.v / b.n, 2) / (POWER(a.v / a.n, 2) / (a.n - 1) + POWER(b.v / b.n, 2) / (b.n - 1)), 2) AS dof,
  a.g AS group_a, b.g AS group_b FROM a, b""",
)
register(
    "chi_square",
    lambda spark, sf: relations.chi_square(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")
    .withColumns({"chi2": F.round("chi2", 4), "p_value": F.round("p_value", 4)}),
    """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, COUNT(*)::DOUBLE AS o FROM lineitem GROUP BY 1, 2),
e AS (SELECT o, SUM(o) OVER (PARTITION BY a) * SUM(o) OVER (PARTITION BY b) / SUM(o) OVER () AS e FROM c),
x AS (SELECT SUM((o - e) * (o - e) / e) AS x FROM e)
SELECT 'Chi-square' AS test, ROUND(ROUND(x, 6), 4) AS chi2, ROUND(ROUND(EXP(-x / 2), 6), 4) AS p_value,
  ((SELECT COUNT(DISTINCT a) FROM c) - 1) * ((SELECT COUNT(DISTINCT b) FROM c) - 1) AS dof, EXP(-x / 2) < 0.05 AS significant
FROM x""",
)
register(
    "fitted_distribution",
    lambda spark, sf: relations.fit_distribution(table(spark, sf, "events"), "value"),
)


def _planted_fits(spark, sf):
    """Orders turned into values of known distributions by evenly spread fractions of their keys; which family is found, and how near its parameters are."""
    part = lambda step: F.greatest(F.pmod(F.col("key") * F.lit(step) + 0.5, F.lit(1.0)), F.lit(1e-9))
    u, v, w = (part(step) for step in (0.8191725133961645, 0.6710436067037893, 0.5497004779019703))
    # few bytes stand for many values
    keys = cut_lineage(spread(table(spark, sf, "orders").select("o_orderkey"), task_rows=200_000))
    orders = keys.select(F.explode(F.sequence(F.col("o_orderkey") * 8, F.col("o_orderkey") * 8 + 7)).alias("key"))
    planted = {
        "gamma": (-2 * (F.ln(u) + F.ln(v) + F.ln(w)), {"shape": 3.0, "scale": 2.0}),  # three waits of mean 2
        "beta": (F.pow(F.sin(1.5707963267948966 * u), F.lit(2.0)), {"a": 0.5, "b": 0.5}),  # the arcsine law
        "lognorm": (F.exp(1 + 0.5 * F.sqrt(-2 * F.ln(u)) * F.cos(2 * 3.141592653589793 * v)), {"log_mean": 1.0, "log_stddev": 0.5}),
        "norm": (10 + 3 * F.sqrt(-2 * F.ln(u)) * F.cos(2 * 3.141592653589793 * v), {"mean": 10.0, "stddev": 3.0}),
    }
    found = None
    for name, (value, parameters) in planted.items():
        fit = relations.fit_distribution(orders.select(value.alias("x")), "x")
        near = F.lit(True)
        for key, true in parameters.items():
            near = near & (F.abs(F.col("parameters")[key] - true) <= 0.02 * true)
        row = fit.select(F.lit(name).alias("planted"), "distribution", F.coalesce(near, F.lit(False)).alias("parameters_close"), "is_good_fit")
        found = row if found is None else found.unionAll(row)
    return found


register(
    "fitted_planted",
    _planted_fits,
    "SELECT p AS planted, p AS distribution, TRUE AS parameters_close, TRUE AS is_good_fit FROM (SELECT UNNEST(['gamma', 'beta', 'lognorm', 'norm']) AS p)",
)
register(
    "mape_by_group",
    lambda spark, sf: relations.mape(
        table(spark, sf, "lineitem").withColumn("expected", F.col("l_quantity") * 1500.0),
        "l_extendedprice", "expected", ["l_returnflag"],
    ).withColumn("mape", F.round("mape", 4)),
    """SELECT l_returnflag, ROUND(ROUND(AVG(ABS((l_extendedprice - l_quantity * 1500.0) / l_extendedprice)), 6), 4) AS mape
FROM lineitem WHERE l_extendedprice <> 0 GROUP BY 1""",
)

# ── time series ─────────────────────────────────────────────────────────────

_PERIOD_SQL = """WITH b AS (SELECT {keys}date_trunc('{grain}', {ts}::TIMESTAMP) AS period, {value}::DOUBLE AS value FROM {table}
  WHERE {ts} IS NOT NULL AND {value} IS NOT NULL),
a AS (SELECT {keys}period, {func}(value) AS pv, COUNT(*) AS row_count, AVG(value) AS pa, MIN(value) AS pmin,
        MAX(value) AS pmax, STDDEV_POP(value) AS psd FROM b GROUP BY {keys}period),
o AS (SELECT {keys}MIN(period) AS s0, MAX(period) AS s1, SUM(pv) AS st, AVG(pv) AS sa, MAX(pv) AS smax, MIN(pv) AS smin,
        REGR_SLOPE(pv, EPOCH(period)) AS slope, REGR_R2(pv, EPOCH(period)) AS r2 FROM a {group}),
w AS (SELECT *, LAG(pv) OVER s AS prev, SUM(pv) OVER (s ROWS UNBOUNDED PRECEDING) AS rt,
        AVG(pv) OVER (s ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS r3, RANK() OVER s AS period_rank,
        COUNT(*) OVER ({partition}) AS total_periods
      FROM a WINDOW s AS ({partition} ORDER BY period))
SELECT {wkeys}STRFTIME(period, '%Y-%m-%dT%H:%M:%S') AS period_iso, period_rank, total_periods, ROUND(pv, 4) AS value, row_count,
  ROUND(pa, 4) AS avg_value, ROUND(pmin, 4) AS min_value, ROUND(pmax, 4) AS max_value, ROUND(psd, 4) AS stddev_value,
  ROUND(prev, 4) AS prev_value, ROUND(pv - prev, 4) AS abs_change, ROUND(100.0 * (pv - prev) / NULLIF(prev, 0), 2) AS pct_change,
  ROUND(r3, 4) AS rolling_3_avg, ROUND(rt, 4) AS running_total,
  STRFTIME(s0, '%Y-%m-%d') AS series_start, STRFTIME(s1, '%Y-%m-%d') AS series_end,
  ROUND(st, 4) AS series_total, ROUND(sa, 4) AS series_avg, ROUND(smax, 4) AS series_max, ROUND(smin, 4) AS series_min,
  ROUND(ROUND(slope, 8), 6) AS trend_slope, ROUND(r2, 4) AS trend_r2,
  CASE WHEN slope > 0 THEN 'up' WHEN slope < 0 THEN 'down' ELSE 'flat' END AS trend_direction
FROM w {join} o {using}"""


def _period_summary(df, ts, value, grain, func="SUM", by=()):
    return timeseries.period_summary(df, ts, value, grain, func, by).withColumns(
        {
            "series_start": F.date_format("series_start", "yyyy-MM-dd"),
            "series_end": F.date_format("series_end", "yyyy-MM-dd"),
            "trend_slope": F.round("trend_slope", 6),
        }
    ).drop("period")


register(
    "period_summary",
    lambda spark, sf: _period_summary(
        table(spark, sf, "orders").withColumn("revenue", F.col("o_totalprice") / 7000.0), "o_orderdate", "revenue", "month"
    ),
    _PERIOD_SQL.format(
        keys="", wkeys="", grain="month", ts="o_orderdate", value="(o_totalprice / 7000.0::DOUBLE)", table="orders", func="SUM",
        group="", partition="", join="CROSS JOIN", using="",
    ),
)
register(
    "period_summary_by_series",
    lambda spark, sf: _period_summary(
        table(spark, sf, "events").withColumn("score", F.col("value") / 7.3), "ts", "score",
        timeseries.choose_granularity(table(spark, sf, "events"), "ts"), "AVG", ["event_type"],
    ),
    _PERIOD_SQL.format(
        keys="event_type, ", wkeys="event_type, ", grain="day", ts="ts", value="(value / 7.3::DOUBLE)", table="events", func="AVG",
        group="GROUP BY event_type", partition="PARTITION BY event_type", join="JOIN", using="USING (event_type)",
    ),
)

_DATETIME_SQL = """WITH d AS (SELECT {c} AS t, COUNT(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1),
g AS (SELECT (EPOCH_US(t) - LAG(EPOCH_US(t)) OVER (ORDER BY t)) / 86400000000.0 AS gap FROM d),
s AS (SELECT MIN(t) AS lo, MAX(t) AS hi, SUM(n)::BIGINT AS n, COUNT(*) AS u FROM d),
m AS (SELECT MEDIAN(gap) AS m, MAX(gap) AS g FROM g WHERE gap IS NOT NULL)
SELECT '{c}' AS column_name, STRFTIME(lo, '%Y-%m-%dT%H:%M:%S') AS min_date, STRFTIME(hi, '%Y-%m-%dT%H:%M:%S') AS max_date,
  FLOOR((EPOCH_US(hi) - EPOCH_US(lo)) / 86400000000.0)::INTEGER AS date_range_days, n AS non_null_count, u AS unique_dates,
  CASE WHEN u <= 2 THEN 'unknown' WHEN m <= 1.5 THEN 'daily' WHEN m <= 8 THEN 'weekly' WHEN m <= 16 THEN 'bi-weekly'
       WHEN m <= 35 THEN 'monthly' WHEN m <= 100 THEN 'quarterly' ELSE 'annual_or_irregular' END AS inferred_frequency,
  u > 2 AND g > 2 * m AS has_gaps FROM s, m"""
register(
    "datetime_profile_dates",
    lambda spark, sf: timeseries.datetime_profile(table(spark, sf, "orders"), "o_orderdate"),
    _DATETIME_SQL.format(c="o_orderdate", table="orders"),
)
register(
    "datetime_profile_moments",
    lambda spark, sf: timeseries.datetime_profile(table(spark, sf, "events"), "ts"),
    _DATETIME_SQL.format(c="ts", table="events"),
)

# ── selecting ───────────────────────────────────────────────────────────────

register(
    "filtered_rows",
    lambda spark, sf: selecting.filter_rows(
        table(spark, sf, "orders"),
        [
            {"column": "o_orderstatus", "op": "IN", "value": ["O", "F"]},
            {"column": "o_totalprice", "op": ">=", "value": 300000},
            {"column": "o_orderpriority", "op": "LIKE", "value": "1-%"},
            {"column": "o_custkey", "op": "IS NOT NULL"},
        ],
        ["o_orderkey", "o_custkey", "o_totalprice"],
        limit=None,
    ),
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'F')
AND o_totalprice >= 300000 AND o_orderpriority LIKE '1-%' AND o_custkey IS NOT NULL""",
)
for _func, _expr in {
    "sum": "ROUND(SUM(l_extendedprice) / 1000, 4)",
    "avg": "ROUND(AVG(l_extendedprice), 4)",
    "count": "COUNT(l_extendedprice)",
    "min": "MIN(l_extendedprice)",
    "max": "MAX(l_extendedprice)",
    "median": "ROUND(MEDIAN(l_extendedprice), 4)",
    "stddev": "ROUND(STDDEV(l_extendedprice), 4)",
    "var_pop": "ROUND(VAR_POP(l_extendedprice) / 1000000, 4)",
}.items():

    def _run(spark, sf, func=_func):
        out = selecting.aggregate(
            table(spark, sf, "lineitem"), func, "l_extendedprice", ["l_returnflag", "l_linestatus"],
            order_by=[{"column": "l_returnflag"}, {"column": "l_linestatus", "desc": True}],
        )
        name = f"{func}_l_extendedprice"
        scale = {"sum": 1000, "var_pop": 1_000_000}.get(func)
        if scale:
            return out.withColumn(name, F.round(F.col(name) / scale, 4))
        return out.withColumn(name, F.round(name, 4)) if func in ("avg", "median", "stddev") else out

    register(
        f"aggregate_{_func}", _run,
        f"SELECT l_returnflag, l_linestatus, {_expr} AS {_func}_l_extendedprice FROM lineitem GROUP BY 1, 2",
    )
register(
    "aggregate_count_star",
    lambda spark, sf: selecting.aggregate(
        table(spark, sf, "orders"), "COUNT_STAR", group_by=["o_orderstatus"],
        filters=[{"column": "o_totalprice", "op": "<", "value": 100000}],
    ),
    "SELECT o_orderstatus, COUNT(*) AS count_star FROM orders WHERE o_totalprice < 100000 GROUP BY 1",
)
register(
    "aggregate_first",
    lambda spark, sf: selecting.aggregate(
        table(spark, sf, "orders"), "FIRST", "o_totalprice", ["o_orderpriority"], order_key="o_orderkey"
    ),
    "SELECT o_orderpriority, ARG_MIN(o_totalprice, o_orderkey) AS first_o_totalprice FROM orders GROUP BY 1",
)
register(
    "aggregate_last",
    lambda spark, sf: selecting.aggregate(
        table(spark, sf, "orders"), "LAST", "o_totalprice", ["o_orderpriority"], order_key="o_orderkey"
    ),
    "SELECT o_orderpriority, ARG_MAX(o_totalprice, o_orderkey) AS last_o_totalprice FROM orders GROUP BY 1",
)
register(
    "aggregate_list",
    lambda spark, sf: selecting.aggregate(table(spark, sf, "nation"), "LIST", "n_name", ["n_regionkey"]).select(
        "n_regionkey", F.concat_ws(",", F.sort_array("list_n_name")).alias("list_n_name")
    ),
    "SELECT n_regionkey, STRING_AGG(n_name, ',' ORDER BY n_name) AS list_n_name FROM nation GROUP BY 1",
)
register(
    "top_orders",
    lambda spark, sf: selecting.top_n(
        table(spark, sf, "orders"), "o_totalprice", 25, ["o_orderkey", "o_totalprice"], tie_break=["o_orderkey"]
    ),
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
register(
    "top_orders_per_priority",
    lambda spark, sf: selecting.top_n_per_group(
        table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", 5, tie_break=["o_orderkey"]
    ).select("o_orderpriority", "o_orderkey", "o_totalprice", "rank"),
    """SELECT o_orderpriority, o_orderkey, o_totalprice, rank FROM (SELECT *, ROW_NUMBER() OVER (
PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5""",
)
register(
    "guarded_sql",
    lambda spark, sf: selecting.run_sql(
        spark,
        "```sql\nSELECT c.c_mktsegment, COUNT(*) AS orders, ROUND(SUM(o.o_totalprice) / 1000, 2) AS revenue_thousands "
        "FROM dataset o JOIN buyers c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment\n```",
        {"dataset": table(spark, sf, "orders"), "buyers": table(spark, sf, "customer")},
    ),
    """SELECT c.c_mktsegment, COUNT(*) AS orders, ROUND(SUM(o.o_totalprice) / 1000, 2) AS revenue_thousands
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment""",
)
_FORMS = """SELECT EXTRACT(YEAR FROM o_orderdate) AS y, COUNT(*) FILTER (WHERE o_totalprice BETWEEN 1000 AND 100000) AS middling,
  COUNT(DISTINCT CASE WHEN o_orderpriority ILIKE '%urgent' THEN o_custkey END) AS urgent_buyers, MAX(o_orderkey % 7) AS top
FROM dataset WHERE o_orderkey NOT IN (1, 2, 3) AND o_custkey IN (SELECT c_custkey FROM buyers WHERE c_acctbal IS NOT NULL)
GROUP BY EXTRACT(YEAR FROM o_orderdate) HAVING COUNT(*) > 1"""
register(
    "guarded_sql_forms",
    lambda spark, sf: selecting.run_sql(spark, _FORMS, {"dataset": table(spark, sf, "orders"), "buyers": table(spark, sf, "customer")}),
    _FORMS.replace("FROM dataset", "FROM orders").replace("FROM buyers", "FROM customer"),
)


def _sql_page(spark, sf):
    """A page of a guarded query within its time limit, with what the page tells about the whole."""
    page = selecting.run_sql_page(
        spark, "SELECT o_orderkey, o_totalprice FROM dataset WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey", {"dataset": table(spark, sf, "orders")}, 100, 300
    )
    return page.rows.select("*", F.lit(page.row_count).alias("row_count"), F.lit(page.truncated).alias("truncated"))


register(
    "guarded_sql_page",
    _sql_page,
    """SELECT o_orderkey, o_totalprice, LEAST(100, (SELECT COUNT(*) FROM orders WHERE o_totalprice > 1000)) AS row_count,
  (SELECT COUNT(*) > 100 FROM orders WHERE o_totalprice > 1000) AS truncated FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
)


def _merged_sketches(spark, sf):
    """Order lines sketched a run per return flag, the runs stored and merged by project; how near the estimates are to the exact values."""
    lines, folder, names = table(spark, sf, "lineitem"), new_folder(spark, "sketches"), ["l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_linestatus"]
    for month, flag in enumerate(["A", "N", "R"], 1):
        part = lines.where(F.col("l_returnflag") == flag)
        sketches.append_sketches(sketches.sketch_columns(part, "lines", "p1", f"run {flag}", 202400 + month, names), folder)
    stored = sketches.read_sketches(spark, folder)
    by_month = sketches.merge_sketches(stored, ["project_id", "yyyymm", "column_name"])
    merged = sketches.sketched_statistics(sketches.merge_sketches(by_month, ["project_id", "column_name"]))
    kept = lines.where(F.col("l_returnflag").isin("A", "N", "R"))
    exact = statistics.distinct_counts(kept, names)
    # a quantile is as near as the share of values up to it is to the share asked for
    q = {r.column_name: r.q for r in merged.where("kind = 'numeric'").select("column_name", "q").collect()}
    ranks = kept.agg(*[
        F.forall(F.array(*[F.struct(F.avg((F.col(c) < v).cast("double")).alias("low"), F.avg((F.col(c) <= v).cast("double")).alias("high"), F.lit(share).alias("share"))
                           for v, share in zip(values, statistics.SHARES)]), lambda x: (x["low"] <= x["share"] + 0.01) & (x["high"] >= x["share"] - 0.01)).alias(c)
        for c, values in q.items()
    ]).unpivot([], list(q), "column_name", "quantiles_close")
    return merged.join(exact, "column_name").join(ranks, "column_name", "left").select(
        "project_id", "column_name", "total_rows", "non_null_count", F.round("mean", 6).alias("mean"), F.round("stddev_pop", 6).alias("stddev_pop"), "min_val", "max_val",
        (F.abs(F.col("unique_estimate") - F.col("unique_count")) <= 0.01 * F.col("unique_count") + 1).alias("distinct_close"),
        F.coalesce("quantiles_close", F.lit(True)).alias("quantiles_close"),
    )


register(
    "merged_sketches",
    _merged_sketches,
    "WITH l AS (SELECT * FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R')) " + " UNION ALL ".join(
        f"SELECT 'p1' AS project_id, '{c}' AS column_name, COUNT(*) AS total_rows, COUNT({c}) AS non_null_count, ROUND(AVG({v}), 6) AS mean, "
        f"ROUND(STDDEV_POP({v}), 6) AS stddev_pop, MIN({v}) AS min_val, MAX({v}) AS max_val, TRUE AS distinct_close, TRUE AS quantiles_close FROM l"
        for c, v in [(c, f"{c}::DOUBLE") for c in ("l_partkey", "l_quantity", "l_extendedprice", "l_discount")] + [("l_linestatus", "NULL::DOUBLE")]
    ),
)


def _sketched_profile(spark, sf):
    """The profile by sketches: what is exact in it, and whether its distinct counts are near those of the exact one."""
    lines = table(spark, sf, "lineitem")
    found, exact = profiling.profile_columns(lines, approx=True), statistics.distinct_counts(lines, lines.columns)
    return found.join(exact.withColumnRenamed("unique_count", "exact"), "column_name").select(
        "column_name", "kind", "total_rows", "non_null_count", "null_count", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "max_length",
        (F.abs(F.col("unique_count") - F.col("exact")) <= 0.01 * F.col("exact") + 1).alias("distinct_close"),
    )


register(
    "sketched_profile",
    _sketched_profile,
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{kind}' AS kind, COUNT(*) AS total_rows, COUNT({c}) AS non_null_count, COUNT(*) - COUNT({c}) AS null_count, "
        + (f"ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_SAMP({c}), 4) AS stddev, " if kind == "numeric" else "NULL::DOUBLE AS mean, NULL::DOUBLE AS stddev, ")
        + (f"MAX(LENGTH({c})) AS max_length, " if kind == "text" else "NULL AS max_length, ") + "TRUE AS distinct_close FROM lineitem"
        for c, kind in [("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"), ("l_linenumber", "numeric"), ("l_quantity", "numeric"),
                        ("l_extendedprice", "numeric"), ("l_discount", "numeric"), ("l_tax", "numeric"), ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "datetime")]
    ),
)
