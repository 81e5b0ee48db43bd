import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.functions import distributions as dist
from siftstone.operators import anomaly, operations, profiling, quantiles, relations, scoring, selecting, statistics, timeseries
from siftstone.operators.profiling import TableProfile


@pytest.fixture(scope="module")
def lines(spark, folder):
    return spark.read.parquet(f"{folder}/lineitem.parquet")


# ── results do not depend on the way the work is cut ────────────────────────


@pytest.mark.parametrize("task_rows", [50, 700, 10_000_000])
def test_quantiles_in_buckets(lines, task_rows):
    shares = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    columns = ["l_extendedprice", "l_quantity", "l_discount"]
    got = {r.column_name: r.q for r in quantiles.column_quantiles(lines, columns, shares, task_rows=task_rows).collect()}
    for c in columns:
        values = np.array([r[0] for r in lines.select(c).collect()])
        assert np.allclose(got[c], np.quantile(values, shares))


def test_grouped_quantiles_with_one_heavy_group(spark):
    """A third of the rows in one group, half of those one value."""
    df = spark.range(9000).select(
        F.when(F.col("id") < 3000, -1).otherwise(F.col("id") % 7).alias("g"),
        F.when(F.col("id") < 1500, 5.0).otherwise((F.col("id") * 37 % 1009).cast("double")).alias("v"),
    )
    wide = quantiles.grouped_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9], task_rows=400)
    pdf = df.toPandas()
    for r in wide.collect():
        assert np.allclose(r.q, np.quantile(pdf.v[pdf.g == r.g], [0.1, 0.5, 0.9]))
    assert wide.count() == 8


def test_null_group_keeps_its_median(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    got = {r.g: r.median_v for r in selecting.aggregate(df, "median", "v", ["g"]).collect()}
    assert got == {None: 2.0, "a": 5.0}
    cut = quantiles.grouped_quantiles(df, ["g"], "v", [0.5], task_rows=1)
    assert {r.g: r.q[0] for r in cut.collect()} == {None: 2.0, "a": 5.0}


@pytest.mark.parametrize("task_rows", [100, 10_000_000])
def test_gini_in_buckets(lines, task_rows):
    values = np.sort(np.array([r[0] for r in lines.select("l_extendedprice").collect()]))
    n = len(values)
    want = ((2 * np.arange(1, n + 1) - n - 1) * values).sum() / (n * values.sum())
    got = statistics.gini(lines, "l_extendedprice", task_rows).first()
    assert got.gini == pytest.approx(want, abs=1e-6)
    assert 0 <= got.gini <= 1


@pytest.mark.parametrize("task_rows", [60, 10_000_000])
def test_datetime_profile_in_buckets(spark, folder, task_rows):
    events = spark.read.parquet(f"{folder}/events.parquet")
    whole = timeseries.datetime_profile(events, "ts").first()
    assert timeseries.datetime_profile(events, "ts", task_rows).first() == whole


def test_transitions_in_slices(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet").withColumn("user_id", F.lit(1))
    arguments = ("user_id", "event_type", "ts", "event_id")
    whole = operations.illegal_transitions(events, *arguments, transitions=[("click", "view")])
    cut = operations.illegal_transitions(events, *arguments, transitions=[("click", "view")], task_rows=90)
    assert sorted(whole.collect()) == sorted(cut.collect())
    assert whole.count() > 100


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_statistics_do_not_depend_on_partitions(lines, parts):
    def facts(df):
        row = statistics.column_statistics(df, "l_extendedprice").first().asDict()
        row.pop("computed_at")
        return {k: round(v, 4) if isinstance(v, float) else v for k, v in row.items() if k not in ("variance", "total_sum")}

    assert facts(lines.repartition(parts)) == facts(lines)


# ── invariants ──────────────────────────────────────────────────────────────


def test_histogram_counts_and_shares(lines):
    rows = statistics.histogram(lines, ["l_extendedprice"]).collect()
    assert len(rows) == 20
    assert sum(r.frequency for r in rows) == lines.count()
    assert sum(r.relative_frequency for r in rows) == pytest.approx(1, abs=1e-4)


def test_histogram_of_a_constant_column(spark):
    rows = statistics.histogram(spark.range(5).select(F.lit(2.0).alias("v")), "v").collect()
    assert sum(r.frequency for r in rows) == 5


def test_entropy_bounds(lines):
    for r in statistics.entropy(lines, ["l_returnflag", "l_suppkey"]).collect():
        assert 0 <= r.entropy <= math.log2(r.categories) + 1e-6
        assert 0 <= r.normalised_entropy <= 1


def test_gini_edges(spark):
    equal = spark.range(10).select(F.lit(4.0).alias("v"))
    assert statistics.gini(equal, "v").first().gini == 0
    assert statistics.gini(equal.limit(1), "v").first().gini == 0


def test_approximate_statistics_are_close(lines):
    exact = statistics.column_statistics(lines, "l_extendedprice").first()
    rough = statistics.column_statistics(lines, "l_extendedprice", approx=True).first()
    assert rough.p50 == pytest.approx(exact.p50, rel=0.01)
    assert rough.unique_count == pytest.approx(exact.unique_count, rel=0.05)
    assert rough.kurtosis == pytest.approx(exact.kurtosis, abs=1e-6)


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "v double")
    row = statistics.column_statistics(df, "v").first()
    assert (row.non_null_count, row.null_count, row.mean) == (2, 2, 2.0)


def test_long_texts_are_counted_by_digest_and_shown_whole(spark):
    df = spark.createDataFrame([("x" * 500,), ("x" * 500,), ("y",)], "t string")
    top = statistics.top_value_counts(df, ["t"], 1).first()
    assert (top.value, top["count"]) == ("x" * 500, 2)


# ── profile ─────────────────────────────────────────────────────────────────


def test_sales_profile(sales):
    profile = profiling.profile_table(sales)
    types = profiling.types_of(profile.columns)
    assert types == {
        "date": "datetime", "region": "free_text", "product": "free_text", "revenue": "currency",
        "units": "numeric_count", "discount_pct": "percentage",
    }
    row = profile.table.first()
    assert (row.duplicate_count, row.completeness_score, row.column_count) == (0, 1.0, 6)


def test_categorical_on_a_large_table(spark):
    df = spark.range(1000).select(F.concat(F.lit("r"), F.col("id") % 4).alias("region"))
    assert profiling.types_of(profiling.profile_table(df).columns) == {"region": "categorical"}


def test_all_null_column(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, None)], "a int, b double")
    rows = {r.column_name: r for r in profiling.profile_columns(df).collect()}
    assert rows["b"].null_count == 3 and rows["b"].unique_count == 0 and rows["b"].mean is None


def test_token_match(spark):
    df = spark.createDataFrame([(1, 2)], "width int, user_id int")
    names = profiling.types_of(profiling.profile_table(df, match="token").columns)
    assert names == {"width": "numeric_count", "user_id": "identifier"}


def test_other_types_are_profiled(spark):
    df = spark.range(4).select(
        F.array(F.col("id") % 2).alias("items"), (F.col("id") > 1).alias("flag"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"),
        F.col("id").cast("decimal(20,4)").alias("exact"),
    )
    rows = {r.column_name: r for r in profiling.profile_table(df).columns.collect()}
    assert rows["items"].kind == "unknown" and rows["items"].unique_count == 2
    assert rows["flag"].semantic_type == "boolean" and set(rows["flag"].sample_values) == {"true", "false"}
    assert rows["day"].semantic_type == "date" and "2024-01-01" in rows["day"].sample_values
    assert rows["exact"].unique_count == 4 and rows["exact"].mean == 1.5


def test_duplicate_count_tells_nulls_apart(spark):
    df = spark.createDataFrame([(None, "x"), ("x", None), ("x", None)], "a string, b string")
    assert profiling.duplicate_rows(df).first().duplicate_count == 1


# ── relations ───────────────────────────────────────────────────────────────


def test_trends(spark):
    days = spark.range(10).select(F.expr("date_add(date'2024-01-01', cast(id as int))").alias("d"), "id")
    up = relations.linear_trend(days.withColumn("s", 100 + 50 * F.col("id")), "d", "s").first()
    assert up.direction == "increasing" and up.r_squared > 0.9 and up.is_significant
    flat = relations.linear_trend(days.withColumn("s", F.lit(500.0)), "d", "s").first()
    assert abs(flat.slope) < 0.01 and flat.r_squared == 0
    assert relations.linear_trend(days.limit(2).withColumn("s", F.col("id")), "d", "s").count() == 0


def test_p_values():
    assert dist.student_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-3)
    assert dist.chi_square_tail(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert dist.chi_square_tail(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert float(dist.normal_cdf(np.array([1.959964]))[0]) == pytest.approx(0.975, abs=1e-6)


def test_welch_known_value(spark):
    a, b = [27.5, 21.0, 19.0, 23.6, 17.0, 17.9], [27.1, 22.0, 20.8, 23.4, 23.4, 23.5]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, v double")
    row = relations.welch_t_test(df, "v", "g").first()
    va, vb = np.var(a, ddof=1) / 6, np.var(b, ddof=1) / 6
    assert row.t_statistic == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt(va + vb), abs=1e-5)
    assert 0.1 < row.p_value < 0.3 and not row.significant
    assert relations.welch_t_test(df.where("g = 'a'"), "v", "g").count() == 0


def test_yates_two_by_two(spark):
    cells = {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 30, ("b", "y"): 5}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "p string, q string")
    row = relations.chi_square(df, "p", "q").first()
    n, ad, bc = 65, 10 * 5, 20 * 30
    want = n * (abs(ad - bc) - n / 2) ** 2 / (30 * 35 * 40 * 25)
    assert row.chi2 == pytest.approx(want, abs=1e-4) and row.dof == 1


@pytest.mark.parametrize("task_rows", [150, 10_000_000])
def test_distribution_fit(spark, task_rows):
    normal = spark.range(4000).select((F.randn(7) * 15 + 100).alias("v"))
    expo = spark.range(4000).select((-F.log(1 - F.rand(3)) * 5).alias("v"))
    assert relations.fit_distribution(normal, "v", task_rows).first().distribution in ("norm", "gamma", "lognorm", "beta")
    row = relations.fit_distribution(expo, "v", task_rows).first()
    assert row.distribution in ("expon", "gamma") and row.ks_statistic < 0.05
    assert relations.fit_distribution(expo.limit(5), "v").first().distribution == "unknown"


def test_mape_skips_zeros(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 9.0), (20.0, 24.0)], "a double, p double")
    assert relations.mape(df, "a", "p").first().mape == pytest.approx(0.15)


# ── selecting ───────────────────────────────────────────────────────────────


def test_selecting(sales):
    assert selecting.filter_rows(sales, [{"column": "region", "op": "=", "value": "North"}]).count() == 4
    assert selecting.top_n(sales, "revenue", 5).count() == 5
    assert selecting.aggregate(sales, "sum", "revenue").first()["sum_revenue"] == pytest.approx(18402.75)
    with pytest.raises(ValueError):
        selecting.aggregate(sales, "DROP TABLE", "revenue")
    with pytest.raises(ValueError):
        selecting.filter_rows(sales, [{"column": "region", "op": "~", "value": "x"}])


def test_guarded_sql(spark, sales):
    views = {"dataset": sales}
    assert selecting.run_sql(spark, "SELECT SUM(revenue) AS s FROM dataset", views).count() == 1
    page, rows, cut, _ = selecting.run_sql_page(spark, "SELECT * FROM dataset", views, 4)
    assert rows == 4
    assert cut and page.count() == 4
    quoted = "SELECT * FROM dataset WHERE region = 'set -- x'"
    assert selecting.run_sql(spark, quoted, views).count() == 0
    for bad in ("DROP TABLE dataset", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/etc`",
                "SELECT * FROM READ_CSV('x')", "", "EXEC x"):
        with pytest.raises(ValueError):
            selecting.run_sql(spark, bad, views)
    assert not spark.catalog.tableExists("dataset")


# ── scores ──────────────────────────────────────────────────────────────────


def fake_profile(spark, complete, consistent, null_rates=(0.0,), kind="numeric", rows=500):
    columns = spark.createDataFrame(
        [(i, f"c{i}", r, kind, "currency", 1234.56) for i, r in enumerate(null_rates)],
        "ordinal int, column_name string, null_rate double, kind string, semantic_type string, mean double",
    )
    table = spark.createDataFrame(
        [(rows, len(null_rates), 0, complete, consistent)],
        "row_count long, column_count int, duplicate_count long, completeness_score double, consistency_score double",
    )
    return TableProfile(columns, table)


def test_quality_scores(spark):
    best = scoring.quality_score(fake_profile(spark, 1.0, 1.0)).first()
    assert best.overall_score == pytest.approx(0.95) and best.grade in ("A", "B") and best.timeliness == 0.5
    assert scoring.quality_score(fake_profile(spark, 0.5, 1.0)).first().overall_score < 0.80
    assert scoring.quality_score(fake_profile(spark, 1.0, 1.0, (0.6, 0.6))).first().validity == 0
    assert scoring.quality_score(fake_profile(spark, 1.0, 1.0, kind="datetime")).first().timeliness == 1.0
    assert scoring.quality_score(fake_profile(spark, 0.1, 0.1, (0.9,))).first().grade == "F"


def test_cards(spark):
    cards = {r.name: r.value for r in scoring.kpi_cards(fake_profile(spark, 0.9, 1.0)).collect()}
    assert cards["Total Rows"] == 500 and cards["Avg c0"] == 1234.56 and cards["Completeness"] == 90.0
    short = scoring.kpi_cards(fake_profile(spark, 0.9, 1.0, (0.0,) * 20), consistency=False, total_cap=10)
    assert short.count() == 10


def test_usage(spark):
    calls = spark.createDataFrame([("m", 100, 50), ("m", 200, 80)], "model string, input_tokens long, output_tokens long")
    row = operations.usage_by(operations.priced_calls(calls), ["model"]).first()
    assert (row.input_tokens, row.output_tokens, row.total_tokens) == (300, 130, 430)


def test_lifecycle_finds_the_skipped_stage(spark):
    df = spark.createDataFrame(
        [("d", "uploaded", "2024-01-01 00:00:00", 1), ("d", "profiling", "2024-01-01 00:01:00", 2),
         ("d", "ready", "2024-01-01 00:02:00", 3)], "entity string, status string, ts string, id int",
    )
    bad = operations.illegal_transitions(df, "entity", "status", "ts", "id").collect()
    assert [(r.prev_status, r.status) for r in bad] == [("profiling", "ready")]


def test_rate_windows_across_slices(spark):
    """A burst over the border of a slice is seen whole, for one client with all requests."""
    df = spark.range(120).select(F.lit("c").alias("c"), F.timestamp_seconds(7200 - 30 + F.col("id") / 2).alias("t"))
    rows = operations.requests_over_limit(df, "c", "t", 60, 60).orderBy("second").collect()
    seconds = [7200 - 30 + i // 2 for i in range(120)]
    want = {s: sum(1 for x in seconds if s - 59 <= x <= s) for s in set(seconds)}
    assert {r.second: r.in_window for r in rows} == {s: n for s, n in want.items() if n > 60}


@pytest.mark.parametrize("text", [
    "SELECT * FROM secret", "SELECT (SELECT MAX(revenue) FROM secret) AS m FROM dataset", "SELECT * FROM dataset WHERE units IN (SELECT units FROM secret)",
    "SELECT java_method('java.util.UUID', 'randomUUID')", "SELECT reflect('java.util.UUID', 'randomUUID') FROM dataset", "SELECT * FROM parquet.`/root/testdata`",
    "WITH secret AS (SELECT 1) SELECT * FROM secret", "SELECT TRANSFORM(region) USING 'cat' FROM dataset", "DROP VIEW secret", "SELECT 1; SELECT 2", "SELECT input_file_name() FROM dataset",
    "INSERT INTO dataset SELECT * FROM dataset", "SELECT * FROM range(5)", "SELECT explode(array(java_method('a', 'b')))", "", None,
])
def test_sql_guard_refuses(spark, sales, text):
    sales.createOrReplaceTempView("secret")
    with pytest.raises(ValueError):
        selecting.run_sql(spark, text, {"dataset": sales})


def test_sql_guard_leaves_the_callers_views(spark, sales):
    spark.range(3).createOrReplaceTempView("dataset")
    text = """SELECT region, SUM(revenue) AS s, 'drop; -- /* text' AS t FROM dataset d JOIN (SELECT DISTINCT region AS r FROM dataset) x ON d.region = x.r
        WHERE units >= 0 AND product LIKE 'Widget%' GROUP BY region HAVING COUNT(*) > 1 ORDER BY s DESC LIMIT 3"""
    assert selecting.run_sql(spark, text, {"dataset": sales}).count() == 3
    assert spark.table("dataset").count() == 3
    spark.catalog.dropTempView("dataset")


def test_nothing_is_capped_by_default(spark):
    many = spark.range(1500).selectExpr("id", "id AS k", "IF(id < 800, 1000.0 + id, id % 10) AS value")
    assert selecting.aggregate(many, "SUM", "value", ["k"]).count() == 1500
    assert selecting.filter_rows(many).count() == 1500
    spread = spark.range(20_000).selectExpr("id", "IF(id < 700, 100000.0 + id, id % 100) AS value")
    assert anomaly.two_method_candidates(spread, ["id"], "value").count() == 700
    assert anomaly.modified_zscore(spread, ["id"], "value").count() == 700


def test_tree_samples_of_a_huge_table(spark):
    """The bound of the thinning holds for tables of which a tree sees almost nothing."""
    from siftstone.operators import forest

    assert forest._bound(1.0) == 2**63 - 1 and forest._bound(0.5) == 0
    share = 1.5 * forest.TREE_ROWS * 100 / 1e12
    assert forest._bound(share) + 2**63 == pytest.approx(share * 2**64)
