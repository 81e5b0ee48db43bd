"""Work that grows with the rows has tasks that grow with them, and gives the same rows."""

from pyspark.sql import functions as F

from siftstone import session
from siftstone.operators import learning, screening


def test_few_bytes_with_many_rows_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(session, "SPREAD_ROWS", 100)
    df = spark.range(0, 1000, 1, 1).withColumn("text", F.lit("The share was 120% of cost. Demand always rises."))
    dealt = session.spread(df)
    assert dealt.rdd.getNumPartitions() == 10 and session.spread(df.limit(90)).rdd.getNumPartitions() == 1
    found = screening.validate_responses(dealt, ["id"], "text")
    assert {tuple(r) for r in found.select("claim_issues", "is_valid").collect()} == {(1, False)} and found.count() == 1000


def test_the_answers_queries_spread_their_rows(spark, folder, monkeypatch):
    from siftstone.plans import text_queries

    monkeypatch.setattr(session, "SPREAD_ROWS", 50)
    assert text_queries._claims(spark, folder).rdd.getNumPartitions() > 1
    assert text_queries._query_texts(spark, folder).rdd.getNumPartitions() > 1


def test_a_forest_is_trained_in_several_tasks_and_always_alike(spark, monkeypatch):
    rows = spark.range(0, 600, 1, 1).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 7 * 3.5).alias("y"))
    types = {"a": "numeric_count", "b": "numeric_count"}
    assert learning._dealt(rows, ["id"]).rdd.getNumPartitions() == 1
    monkeypatch.setattr(learning, "SPREAD_ROWS", 100)
    assert learning._dealt(rows, ["id"]).rdd.getNumPartitions() == 6
    first, again = (learning.learn(rows, "y", types, ["id"], trees=5).importances.collect() for _ in range(2))
    assert first == again and first[0].feature == "a" and first[0].importance > 0.9


def test_a_large_key_lands_in_several_files(spark, tmp_path):
    from siftstone.plans import operations_queries as queries

    rows = spark.range(0, 1000, 1, 1).select("id", F.when(F.col("id") % 10 == 0, "small").when(F.col("id") > 3, "large").alias("kind"))
    queries._landed(rows, "kind", str(tmp_path / "out"), "parquet", 100)
    read = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, read.select("id", "kind").collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    sizes = read.groupBy("kind", F.input_file_name()).count().collect()
    assert max(r["count"] for r in sizes) < 350 and sum(r.kind == "large" for r in sizes) > 4 and sum(r.kind == "small" for r in sizes) == 1
    queries._landed(rows, "kind", str(tmp_path / "few"), "parquet")
    assert len(list((tmp_path / "few").glob("*/part-*"))) == 3


def test_a_folder_of_several_files_is_one_row_per_write(spark, folder, monkeypatch):
    from siftstone.plans import operations_queries as queries

    read = queries.table
    without = lambda df: df.withColumn("lang", F.when(F.col("doc_id") % 9 > 0, F.col("lang")))
    monkeypatch.setattr(queries, "table", lambda spark, sf, name: without(read(spark, sf, name)) if name == "documents" else read(spark, sf, name))
    whole = sorted(map(tuple, queries._landing_catalog(spark, folder).collect()), key=str)
    monkeypatch.setattr(queries, "TEXT_ROWS", 10)
    monkeypatch.setattr(queries._landed, "__defaults__", (100,))
    assert sorted(map(tuple, queries._landing_catalog(spark, folder).collect()), key=str) == whole
    assert sum(r[:2] == ("csv", "__HIVE_DEFAULT_PARTITION__") for r in whole) == 2  # one that is Latin-1, one that is UTF-8


def test_quoted_documents_are_written_by_many_tasks(spark, folder, tmp_path, monkeypatch):
    from siftstone.plans import operations_queries as queries

    monkeypatch.setattr(queries, "new_folder", lambda spark, label: str(tmp_path / label))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        queries._late_quotes(spark, folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [f.stat().st_size for f in (tmp_path / "quoted/utf").glob("part-*")]
    assert len(sizes) > 4 and max(sizes) < 0.4 * sum(sizes)


def test_ranks_are_counted_without_the_other_columns_joins(spark, monkeypatch):
    from siftstone.operators import relations

    seen, cuts = [], relations.cut_points
    monkeypatch.setattr(relations, "cut_points", lambda df, *more: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or cuts(df, *more))
    rows = spark.range(200).select((F.col("id") % 3).alias("a"), (F.col("id") * 7 % 11).alias("b"), (-F.col("id")).alias("c"))
    few = relations.spearman(rows, ["a", "b", "c"]).orderBy("col_a", "col_b").collect()
    assert len(seen) == 3 and not any("Join" in plan for plan in seen)
    monkeypatch.setattr(relations, "BROADCAST_VALUES", 0)
    again = relations.spearman(rows, ["a", "b", "c"]).orderBy("col_a", "col_b").collect()
    want = rows.toPandas().corr("spearman")
    assert [(r.col_a, r.col_b, r.n) for r in few] == [("a", "b", 200), ("a", "c", 200), ("b", "c", 200)]
    assert all(abs(r.r - want[r.col_a][r.col_b]) < 1e-9 and abs(r.r - s.r) < 1e-9 for r, s in zip(few, again))


def test_the_widest_gap_is_found_with_few_points_computed():
    import numpy as np

    from siftstone.operators import relations

    random = np.random.default_rng(5)
    for n, shift in ((1, 0.0), (40, 0.3), (5000, 0.01), (60_000, 0.2)):
        v = np.unique(random.random(n) ** 2)
        upto = np.arange(1, len(v) + 1) / len(v)
        below, calls = upto - 1 / len(v), []
        cdf = lambda x: calls.append(len(x)) or np.clip(np.sqrt(x) + shift * x, 0, 1)
        got = relations._widest_gaps(cdf, v, below, upto)
        used, f = sum(calls), cdf(v)
        assert got == ((upto - f).max(), (f - below).max())
        assert n < 20_000 or used < len(v) / 4


def test_a_fit_counts_values_once(spark, monkeypatch):
    import numpy as np

    from siftstone.functions import distributions as dist
    from siftstone.operators import relations

    seen, cuts = [], relations.cut_points
    monkeypatch.setattr(relations, "cut_points", lambda df, *more: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or cuts(df, *more))
    rows = spark.range(4000).select(F.sqrt(F.col("id") + 1.0).alias("v"))
    fits = [relations.fit_distribution(rows, "v", n).first() for n in (None, 500)]
    assert fits[0] == fits[1] and not any("Aggregate" in plan for plan in seen)
    ties = rows.select(F.floor("v").cast("double").alias("v"))
    x = ties.toPandas()["v"].to_numpy()
    upto = np.array([(x <= y).mean() for y in np.unique(x)])
    below = np.append(0.0, upto[:-1])
    for n in (None, 500):
        found = relations.fit_distribution(ties, "v", n).first()
        f = dist.cdf(found.distribution, np.unique(x), found.parameters)
        assert abs(found.ks_statistic - max((upto - f).max(), (f - below).max())) < 1e-6


def test_keyword_search_holds_few_postings_at_a_time(spark, monkeypatch):
    from siftstone.operators import retrieval

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("v"), F.col("id") % 11), F.lit("all")).alias("text"))
    asked = spark.createDataFrame([(1, "w3 v5"), (2, "w1 all none"), (3, "nothing")], "query_id int, text string")
    slices, sliced = [], retrieval._sliced
    monkeypatch.setattr(retrieval, "_sliced", lambda items, queries, n: slices.append(n) or sliced(items, queries, n))
    whole = sorted(map(tuple, retrieval.bm25(docs, asked, 3).collect()))
    monkeypatch.setattr(retrieval, "SLICE_POSTINGS", 100)
    assert sorted(map(tuple, retrieval.bm25(docs, asked, 3).collect())) == whole and len(whole) == 6
    assert slices[0] == 1 and slices[1] >= 4


def test_best_scores_by_groups():
    import numpy as np

    from siftstone.operators import retrieval

    random = np.random.default_rng(3)
    for n in (10, 5000, 5003):
        scores = np.round(random.random((6, n)), 3)
        scores[1], scores[2, 5:], scores[3, :7] = -np.inf, -np.inf, 2.0
        row, place = retrieval._tops(scores, 4)
        for i, own in enumerate(scores):
            finite = np.sort(own[np.isfinite(own)])[-4:]
            got = place[row == i]
            assert len(set(got.tolist())) == len(got) and (len(finite) == 0) == (len(got) == 0)
            assert not len(finite) or set(np.flatnonzero(np.isfinite(own) & (own >= finite[0])).tolist()) <= set(got.tolist())


def test_short_vectors_are_searched_in_bounded_slices(spark, monkeypatch):
    from siftstone.operators import retrieval

    angle = F.col("id") * 0.7
    items = spark.range(3000).select("id", F.array(F.cos(angle), F.sin(angle)).alias("embedding"), F.concat(F.lit("s"), F.col("id") % 2).alias("scope"))
    asked = items.where("id % 500 = 0").withColumnRenamed("id", "query_id")
    for scope in (None, "scope"):
        slices, sliced = [], retrieval._sliced
        with monkeypatch.context() as m:
            m.setattr(retrieval, "_sliced", lambda items, queries, n: slices.append(n) or sliced(items, queries, n))
            whole = sorted(map(tuple, retrieval.search_vectors(items, asked, 5, None, scope=scope).collect()))
            m.setattr(retrieval, "SLICE_ROWS", 400)
            assert sorted(map(tuple, retrieval.search_vectors(items, asked, 5, None, scope=scope).collect())) == whole and len(whole) == 30
        assert slices == [1, 8]


def test_a_job_needs_few_calls_to_the_state():
    import pandas as pd

    from siftstone.streaming.stateful import JobTracker

    class Handle:
        def __init__(self):
            self.calls, self.timers, self.value = 0, set(), None

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls += 1
            return self.value

        def exists(self):
            self.calls += 1
            return self.value is not None

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def listTimers(self):
            self.calls += 1
            return list(self.timers)

        def registerTimer(self, at):
            self.calls += 1
            self.timers.add(at)

        def deleteTimer(self, at):
            self.calls += 1
            self.timers.remove(at)

    hour, handle, tracker = 3_600_000, Handle(), JobTracker(["cleaning"], 7_200_000, 86_400_000)
    tracker.init(handle)
    event = lambda t, s: pd.DataFrame({"at": [t * hour * 1000], "event_id": [str(t)], "status": [s]})
    first = pd.concat(tracker.handleInputRows(("a",), iter([event(1, "cleaning")]), None))
    assert first["kind"].tolist() == ["status"] and handle.timers == {3 * hour + 1} and handle.calls <= 3
    later = pd.concat(tracker.handleInputRows(("a",), iter([event(9, "cleaning"), event(5, "ready")]), None))
    assert later["kind"].tolist() == ["stalled", "status", "status"] and handle.timers == {11 * hour + 1} and handle.calls <= 7
    assert later["at"].dt.hour.tolist() == [1, 5, 9]
