import threading
import time

import pytest
from pyspark.sql import functions as F

from siftstone.operators import learning, selecting


def run(spark, sql, views):
    return [tuple(r) for r in selecting.run_sql(spark, sql, views).collect()]


@pytest.fixture(scope="module")
def views(spark):
    rows = [(i, f"n{i % 3}", float(i) if i % 4 else None, [i, i + 1]) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, name string, amount double, both array<int>").withColumn("day", F.expr("date_add(DATE'2024-01-30', id)"))
    return {"dataset": df, "other": df.select("id", F.col("name").alias("label"))}


ALLOWED = [
    ("SELECT id FROM dataset WHERE id BETWEEN 1 AND 2 AND id NOT BETWEEN 2 AND 5", 1),
    ("SELECT EXTRACT(YEAR FROM day) AS y, extract(month from day) AS m, date_part('day', day) AS d FROM dataset", 12),
    ("SELECT name, SUM(amount) FILTER (WHERE id > 3) AS s, COUNT(DISTINCT id) FROM dataset GROUP BY name HAVING COUNT(*) > 1 ORDER BY 1", 3),
    ("SELECT name, GROUPING_ID() FROM dataset GROUP BY ROLLUP(name)", 4),
    ("SELECT name FROM dataset GROUP BY GROUPING SETS ((name), ())", 4),
    ("SELECT id, SUM(amount) OVER w, ROW_NUMBER() OVER (ORDER BY id DESC NULLS LAST) FROM dataset WINDOW w AS (PARTITION BY name ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)", 12),
    ("SELECT PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY amount) FROM dataset", 1),
    ("SELECT d.id, label FROM dataset d JOIN other USING (id) WHERE EXISTS (SELECT 1 FROM other o WHERE o.id = d.id) AND id IN (SELECT id FROM other)", 12),
    ("SELECT id, v FROM dataset LATERAL VIEW explode(both) t AS v", 24),
    ("SELECT CASE WHEN amount IS NULL THEN 'none' ELSE name || '!' END, CAST(id AS STRING), TRY_CAST(name AS INT), id % 2, id DIV 2, -id, ~id, id & 1 FROM dataset", 12),
    ("SELECT transform(both, x -> x + 1)[0], named_struct('a', 1).a, NVL(amount, 0), NULLIF(id, 1) FROM dataset WHERE name ILIKE 'N%' AND name RLIKE '^n' AND name LIKE ANY ('n0', 'n1')", 8),
    ("SELECT * EXCEPT (both) FROM dataset UNION ALL SELECT id, name, amount, day FROM dataset", 24),
    ("SELECT a + b FROM (VALUES (1, 2), (3, 4)) AS v(a, b)", 2),
    ("SELECT (SELECT MAX(id) FROM dataset), substring(name FROM 1 FOR 1), trim(BOTH 'n' FROM name), position('n' IN name) FROM dataset LIMIT 3 OFFSET 1", 3),
    ("SELECT id FROM dataset WHERE day > DATE '2024-02-01' + INTERVAL 2 DAYS AND amount IS DISTINCT FROM 3", 7),
    ("SELECT 'IDENTIFIER(''reflect'')', `id` FROM dataset -- IDENTIFIER('reflect')", 12),
]

REFUSED = [
    "SELECT IDENTIFIER('java_method')('java.util.UUID', 'randomUUID') FROM dataset",
    "SELECT identifier('re' || 'flect')('java.lang.System', 'getProperty', 'user.home') FROM dataset",
    "SELECT IDENTIFIER('abs')(id) FROM dataset",
    "SELECT IDENTIFIER('id') FROM dataset",
    "SELECT * FROM IDENTIFIER('dataset')",
    "SELECT id FROM dataset ORDER BY IDENTIFIER('id')",
    "SELECT (SELECT IDENTIFIER('reflect')('java.lang.System', 'lineSeparator')) FROM dataset",
    "SELECT transform(both, x -> IDENTIFIER('java_method')('java.lang.Math', 'abs', x)) FROM dataset",
    "SELECT java_method('java.util.UUID', 'randomUUID') FROM dataset",
    "SELECT `reflect`('java.util.UUID', 'randomUUID') FROM dataset",
    "SELECT system.builtin.reflect('java.util.UUID', 'randomUUID') FROM dataset",
    "SELECT try_reflect('java.util.UUID', 'randomUUID') FROM dataset",
    "SELECT current_user FROM dataset",
    "SELECT session_user, id FROM dataset",
    "SELECT current_catalog() FROM dataset",
    "SELECT input_file_name() FROM dataset",
    "SELECT version() FROM dataset",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`",
    "SELECT * FROM csv.`/etc/passwd`",
    "SELECT * FROM hidden",
    "SELECT * FROM global_temp.dataset",
    "SELECT * FROM range(10)",
    "SELECT * FROM read_files('/etc')",
    "WITH x AS (SELECT 1) SELECT * FROM x",
    "SELECT :p FROM dataset",
    "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM dataset",
    "SELECT raise_error(name) FROM dataset",
    "DROP TABLE dataset",
    "SELECT 1; SELECT 2",
    "SET spark.sql.ansi.enabled = false",
    "EXPLAIN SELECT * FROM dataset",
    "",
]


@pytest.mark.parametrize("sql, rows", ALLOWED)
def test_allowed(spark, views, sql, rows):
    assert len(run(spark, sql, views)) == rows


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, views, sql):
    views["dataset"].createOrReplaceTempView("hidden")
    try:
        with pytest.raises(ValueError):
            selecting.run_sql(spark, sql, views)
    finally:
        spark.catalog.dropTempView("hidden")


def test_a_callers_view_may_hold_anything(spark, views):
    named = views["dataset"].withColumn("place", F.expr("java_method('java.lang.Math', 'abs', id)")).withColumn("upper", F.udf(str.upper)("name"))
    assert run(spark, "SELECT upper, place FROM dataset WHERE id = 3", {"dataset": named}) == [("N0", "3")]


def test_a_long_query_ends_and_a_short_one_beside_it_does_not(spark):
    big = {"dataset": spark.range(0, 200_000, 1, 8)}
    slow = "SELECT SUM(a.id % 7) FROM dataset a JOIN dataset b ON a.id % 1000 <> b.id % 999"
    results, begin = {}, time.perf_counter()

    def short():
        results["short"] = selecting.run_sql_page(spark, "SELECT COUNT(*) AS n FROM dataset", big, timeout=60).rows.first().n

    beside = threading.Thread(target=short)
    beside.start()
    with pytest.raises(TimeoutError):
        selecting.run_sql_page(spark, slow, big, timeout=3)
    assert time.perf_counter() - begin < 30
    beside.join()
    assert results == {"short": 200_000}
    tracker = spark.sparkContext.statusTracker()
    for _ in range(50):  # nothing of it goes on in the executors
        if not tracker.getActiveJobsIds():
            break
        time.sleep(0.1)
    assert not tracker.getActiveJobsIds()
    page = selecting.run_sql_page(spark, "SELECT id FROM dataset", big, 5)
    assert page.row_count == 5 and page.truncated and not spark.getTags()


def test_a_job_that_begins_after_the_limit_ends_too(spark):
    big = spark.range(0, 200_000, 1, 8)
    begin = time.perf_counter()
    with pytest.raises(TimeoutError), selecting.time_limit(spark, 0.2):
        time.sleep(0.6)
        big.alias("a").join(big.alias("b"), F.expr("a.id % 1000 <> b.id % 999")).selectExpr("SUM(a.id % 7)").collect()
    assert time.perf_counter() - begin < 15


def test_a_forest_is_learned_after_a_time_limit(spark):
    """Its model holds the session, which the limit must leave fit to be sent along."""
    with selecting.time_limit(spark, 600):
        df = spark.range(60).selectExpr("id", "CAST(id % 10 AS double) AS amount", "CAST(id % 10 > 4 AS int) AS label")
        assert df.count() == 60
    assert learning.learn(df, "label", {"amount": "currency"}, ["id"], trees=2).summary.first().task == "classification"


def test_errors_stay_errors(spark, views):
    with pytest.raises(ValueError):
        selecting.run_sql_page(spark, "SELECT IDENTIFIER('abs')(id) FROM dataset", views)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        selecting.run_sql_page(spark, "SELECT id / (id - id) FROM dataset", views)
