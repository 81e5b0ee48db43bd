import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftstone.operators import keyword_index, retrieval


def docs_of(spark, n, seed, first=0):
    random_ = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Über", "x y"]
    rows = [(i, " ".join(random_.choice(vocabulary[: 5 + i % 38]) for _ in range(random_.randrange(25)))) for i in range(first, first + n)]
    return spark.createDataFrame([*rows, (10_000 + first, None), (20_000 + first, "")], "doc_id long, text string")


QUERIES = [("a", "w1 w30"), ("b", "W2 w2 w3"), ("c", "absent"), ("d", None), ("e", "über w39 w38 w37"), ("f", "w0 w1 w2 w3 w4")]


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.document_id, r.score) for r in df.collect())


@pytest.fixture()
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id string, text string")


@pytest.mark.parametrize("span", [7, 20_000])
def test_equals_search_without_index(spark, tmp_path, queries, monkeypatch, span):
    monkeypatch.setattr(keyword_index, "SPAN_DOCS", span)
    docs = docs_of(spark, 150, 1)
    index = keyword_index.build_index(docs, str(tmp_path / "i"))
    for k in (1, 3, 10):
        found = keyword_index.search_index(index, queries, k)
        assert rows_of(found.rows) == rows_of(retrieval.bm25(docs, queries, k))
        assert found.looked <= found.matching
    monkeypatch.setattr(retrieval, "BROADCAST_WORDS", 0)
    monkeypatch.setattr(keyword_index, "BROADCAST_ROWS", 0)
    again = keyword_index.search_index(keyword_index.open_index(spark, index.folder), queries, 3)
    assert rows_of(again.rows) == rows_of(retrieval.bm25(docs, queries, 3))


def test_spans_that_cannot_win_are_left_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "SPAN_DOCS", 10)
    rows = [(i, "common " * (1 + i % 3) + f"filler{i} more words here") for i in range(200)] + [(i, "rare needle") for i in (300, 301, 302)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = keyword_index.build_index(docs, str(tmp_path / "i"))
    queries = spark.createDataFrame([("q", "rare needle common")], "query_id string, text string")
    found = keyword_index.search_index(index, queries, 1)
    assert rows_of(found.rows) == rows_of(retrieval.bm25(docs, queries, 1))
    assert found.matching > 15 and found.looked < found.matching / 3


def test_changes(spark, tmp_path, queries, monkeypatch):
    monkeypatch.setattr(keyword_index, "SPAN_DOCS", 30)
    docs, new = docs_of(spark, 120, 2), docs_of(spark, 60, 3, first=90)
    index = keyword_index.build_index(docs, str(tmp_path / "i"))
    now = docs.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new)
    for _ in range(2):
        keyword_index.upsert(index, new)
        assert rows_of(keyword_index.search_index(index, queries, 4).rows) == rows_of(retrieval.bm25(now, queries, 4))
    keyword_index.delete(index, now.where("doc_id % 3 = 0").selectExpr("doc_id AS id"))
    keyword_index.delete(index, spark.createDataFrame([(77_777,)], "id long"))
    now = now.where("doc_id % 3 <> 0")
    assert rows_of(keyword_index.search_index(index, queries, 4).rows) == rows_of(retrieval.bm25(now, queries, 4))
    keyword_index.delete(index, now.selectExpr("doc_id AS id"))
    assert keyword_index.search_index(index, queries, 4).rows.count() == 0


def test_text_ids_and_empty_tables(spark, tmp_path, queries):
    docs = docs_of(spark, 40, 5).selectExpr("concat('d', doc_id) AS doc_id", "text")
    index = keyword_index.build_index(docs, str(tmp_path / "i"))
    assert rows_of(keyword_index.search_index(index, queries, 3).rows) == rows_of(retrieval.bm25(docs, queries, 3))
    assert keyword_index.search_index(index, queries.where("query_id = 'c'"), 3).rows.count() == 0
    empty = keyword_index.build_index(docs.where("doc_id = ''"), str(tmp_path / "e"))
    assert keyword_index.search_index(empty, queries, 3).rows.count() == 0
    keyword_index.upsert(empty, docs)
    assert rows_of(keyword_index.search_index(empty, queries, 3).rows) == rows_of(retrieval.bm25(docs, queries, 3))


def test_words_are_cut_as_by_the_search_without_index(spark):
    texts = ["", " ", "a", "  a\u2003b\u00a0\u3000c\x85d\x0b\x1ce ", "\u200b x\u180ey\u2028z", "no space", None, "Ä\tÖ\r\nü"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").selectExpr("i", "text", "lower(text) AS low")
    found = {r.i: (r.low, r.w) for r in rows.select("i", "low", retrieval.tokens(F.col("text")).alias("w")).collect()}
    assert keyword_index._split(pa.array([found[i][0] for i in range(len(texts))])).to_pylist() == [found[i][1] for i in range(len(texts))]


def test_words_are_written_once(spark, tmp_path):
    index = keyword_index.build_index(docs_of(spark, 120, 2), str(tmp_path / "i"))
    assert index.table("maxima").count() == 0
    assert index.table("cells").where("term IS NOT NULL AND (df <> size(places) OR df IS NULL)").count() == 0


def test_changes_move_no_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "SPAN_DOCS", 30)
    index = keyword_index.build_index(docs_of(spark, 120, 2), str(tmp_path / "i"))
    cells = index.table("cells").where("term IS NOT NULL")
    gone = spark.range(0, 120, 7)
    dead = gone.join(index.table("cells").where("term IS NULL").selectExpr("span", "posexplode(ids) AS (place, id)"), "id").select("span", "place")
    expected = cells.selectExpr("span", "term", "explode(places) AS place").join(dead, ["span", "place"]).groupBy("term", "span").count()
    plans, explode = [], F.explode
    monkeypatch.setattr(keyword_index.F, "explode", lambda c: plans.append(c) or explode(c))
    keyword_index.delete(index, gone)
    monkeypatch.undo()
    assert not plans
    assert {(r.term, r.span, -r.df) for r in index.table("maxima").collect()} == {(r.term, r.span, r["count"]) for r in expected.collect()}
