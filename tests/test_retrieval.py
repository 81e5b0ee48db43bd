import numpy as np
from pyspark.sql import functions as F

from siftstone.operators import retrieval


def vectors(spark, n, seed, name):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 1, (n, 8)))]
    return spark.createDataFrame(rows, f"{name} int, embedding array<double>")


def test_search_equals_brute_force_over_several_slices(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 7)
    monkeypatch.setattr(retrieval, "SLICE_NUMBERS", 400)
    chunks, queries = vectors(spark, 300, 1, "id"), vectors(spark, 20, 2, "query_id")
    got = {(r.query_id, r["rank"]): r.chunk_id for r in retrieval.search_vectors(chunks, queries, 5, None).collect()}
    a = np.array([r.embedding for r in chunks.orderBy("id").collect()])
    b = np.array([r.embedding for r in queries.orderBy("query_id").collect()])
    a, b = a / np.linalg.norm(a, axis=1)[:, None], b / np.linalg.norm(b, axis=1)[:, None]
    for q in range(20):
        assert [got[q, k] for k in range(1, 6)] == list(np.argsort(-(a @ b[q]), kind="stable")[:5])


def test_copies_tie_by_id(spark):
    chunks = spark.range(500).select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    queries = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, embedding array<double>")
    found = retrieval.search_vectors(chunks, queries, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in found] == [0, 1, 2] and found[0].score == 1.0


def test_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(retrieval.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def test_null_and_odd_vectors_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [1.0, 2.0, 3.0]), (5, [0.9, 0.1])]
    chunks, queries = spark.createDataFrame(rows, "id int, embedding array<double>"), spark.createDataFrame(rows, "query_id int, embedding array<double>")
    found = {(r.query_id, r.chunk_id) for r in retrieval.search_vectors(chunks, queries, 5).collect()}
    assert found == {(1, 1), (1, 5), (5, 1), (5, 5)}
    assert retrieval.search_vectors(chunks.where("id = 0"), queries, 5).count() == 0
    assert retrieval.search_vectors(chunks, queries.where("query_id = 0"), 5).count() == 0


def test_keyword_search_over_several_slices(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 7} common {'rare' if i == 5 else 'plain'} text {i}") for i in range(60)] + [(60, None), (61, "")], "doc_id int, text string")
    queries = spark.createDataFrame([("a", "rare word5"), ("b", "common"), ("c", "absent"), ("d", None)], "query_id string, text string")
    whole = sorted(map(tuple, retrieval.bm25(docs, queries).collect()))
    monkeypatch.setattr(retrieval, "SLICE_NUMBERS", 20)
    monkeypatch.setattr(retrieval, "BROADCAST_WORDS", 0)
    assert sorted(map(tuple, retrieval.bm25(docs, queries).collect())) == whole
    assert ("a", 5) in {r[:2] for r in whole} and {r[0] for r in whole} == {"a", "b"}


def test_context_stops_at_the_first_block_that_does_not_fit(spark):
    df = spark.createDataFrame(
        [("q", 1, "insight", "a" * 10), ("q", 2, "insight", "b" * 500), ("q", 3, "insight", "c")],
        "query_id string, rank int, chunk_type string, content string",
    )
    row = retrieval.build_context(df, 100).first()
    assert row.blocks == 1 and row.context == "[INSIGHT]\n" + "a" * 10


def test_keyword_boost_is_capped(spark):
    chunks = spark.createDataFrame([(1, "red green blue black white"), (2, "none")], "id int, content string")
    queries = spark.createDataFrame([("q", "red green blue black white")], "query_id string, text string")
    found = spark.createDataFrame([("q", 1, 0.65), ("q", 2, 0.9), ("q", 3, 0.1)], "query_id string, chunk_id int, score double")
    rows = retrieval.rerank(found, queries, chunks).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in rows] == [(1, 0.95), (2, 0.9)]


def test_column_chunks_are_found_by_keyword(spark):
    chunks = spark.createDataFrame(
        [("revenue", "Column: revenue total revenue of the order"), ("region", "Column: region which region"),
         ("discount_pct", "Column: discount rates used"), ("status", "Column: order status breakdown")],
        "doc_id string, text string",
    )
    truth = [("what is the total revenue?", "revenue"), ("which region has most orders?", "region"),
             ("what discount rates are used?", "discount_pct"), ("show me the order status breakdown", "status")]
    queries = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(truth)], "query_id int, text string")
    expected = spark.createDataFrame([(i, c) for i, (_, c) in enumerate(truth)], "query_id int, document_id string")
    assert retrieval.hit_rate(retrieval.bm25(chunks, queries, 3), expected).first().hit_rate == 1.0


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, content string, version int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "id int, content string, version int")
    once = retrieval.upsert_chunks(old, new)
    twice = retrieval.upsert_chunks(once, new)
    assert sorted(once.collect()) == sorted(twice.collect()) and once.where("content = 'c'").count() == 1


def test_words_with_quotes_and_backslashes(spark):
    documents = spark.createDataFrame([(1, r"it's a c:\temp path"), (2, "nothing else")], "doc_id int, text string")
    queries = spark.createDataFrame([("q", r"IT'S c:\temp")], "query_id string, text string")
    rows = retrieval.bm25(documents, queries, 3).collect()
    assert [(r.document_id, r["rank"]) for r in rows] == [(1, 1)] and rows[0].score > 0.5
