import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.operators import retrieval, vector_index


def chunks_of(spark, n, seed, spread=0.15, centres=30, size=6):
    """Vectors around centres, so that partitions mean something."""
    random = np.random.default_rng(seed)
    middle = random.normal(0, 1, (centres, size))
    rows = [(i, [float(x) for x in middle[i % centres] + random.normal(0, spread, size)], f"d{i % 3}", "a" if i % 2 else "b") for i in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<double>, dataset string, kind string")


def queries_of(spark, chunks, every=17):
    return chunks.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "embedding", "dataset")


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


@pytest.fixture()
def indexed(spark, tmp_path):
    chunks = chunks_of(spark, 900, 1)
    return chunks, vector_index.build_index(chunks, str(tmp_path / "index"), 40, scope="dataset", chunk_type="kind")


def test_equals_exact_search_and_reads_few_partitions(spark, indexed):
    chunks, index = indexed
    queries = queries_of(spark, chunks)
    for threshold in (None, 0.9):
        found = vector_index.search_index(index, queries, 5, threshold)
        assert rows_of(found.rows) == rows_of(retrieval.search_vectors(chunks, queries, 5, threshold))
    assert found.probed < 0.1 * found.parts * queries.count()


def test_random_vectors_lose_nothing(spark, tmp_path):
    random = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(random.normal(0, 1, (400, 24)))]
    chunks = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = vector_index.build_index(chunks, str(tmp_path / "i"), 12)
    queries = queries_of(spark, chunks.withColumn("dataset", F.lit("x")), 40)
    assert rows_of(vector_index.search_index(index, queries, 7, None).rows) == rows_of(retrieval.search_vectors(chunks, queries, 7, None))
    few = vector_index.search_index(index, queries, 7, None, probes=2)
    assert few.parts_read <= 12 and few.rows.count() == 70


def test_scope_type_and_slices(spark, indexed, monkeypatch):
    chunks, index = indexed
    monkeypatch.setattr(retrieval, "SLICE_NUMBERS", 60)
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 3)
    queries = queries_of(spark, chunks)
    found = vector_index.search_index(index, queries, 4, None, chunk_type="a", scope="dataset")
    expected = retrieval.search_vectors(
        chunks.withColumnRenamed("kind", "chunk_type"), queries, 4, None, chunk_type="a", scope="dataset"
    )
    assert rows_of(found.rows) == rows_of(expected)


def test_changes(spark, indexed, tmp_path):
    chunks, index = indexed
    queries = queries_of(spark, chunks)
    moved = chunks_of(spark, 900, 8).where("id % 7 = 0").union(chunks_of(spark, 1000, 9).where("id >= 900"))
    for _ in range(2):  # doing it twice changes nothing
        vector_index.upsert(index, moved, scope="dataset", chunk_type="kind")
        now = chunks.join(moved.select("id"), "id", "left_anti").unionByName(moved)
        assert rows_of(vector_index.search_index(index, queries, 5, None).rows) == rows_of(retrieval.search_vectors(now, queries, 5, None))
    vector_index.delete(index, ids=spark.range(0, 300, 2).toDF("id"))
    vector_index.delete(index, scope="d1")
    now = now.where("NOT (id < 300 AND id % 2 = 0) AND dataset <> 'd1'")
    expected = rows_of(retrieval.search_vectors(now, queries, 5, None))
    assert rows_of(vector_index.search_index(vector_index.open_index(spark, index.folder), queries, 5, None).rows) == expected
    fresh = vector_index.compact(index, str(tmp_path / "fresh"))
    assert rows_of(vector_index.search_index(fresh, queries, 5, None).rows) == expected
    assert fresh.table("rows").count() == now.count()
    vector_index.upsert(index, chunks.where("id = 2"), scope="dataset", chunk_type="kind")  # deleted before
    assert vector_index.live_rows(index).where("id = 2").count() == 1


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [1.0, 2.0, 3.0]), (5, [0.9, 0.1]), (6, [0.0, 0.0]), (5, [0.8, 0.1])]
    chunks = spark.createDataFrame(rows, "id int, embedding array<double>")
    index = vector_index.build_index(chunks, str(tmp_path / "i"), 2)
    asked = chunks.withColumnRenamed("id", "query_id").where("query_id <> 5").union(spark.createDataFrame([(8, [0.9, 0.1])], "id int, embedding array<double>"))
    found = rows_of(vector_index.search_index(index, asked, 5, None).rows)
    assert {(q, c) for q, _, c, _ in found} == {(q, c) for q in (1, 6, 8) for c in (1, 5, 6)}
    assert vector_index.search_index(index, asked.where("query_id = 0"), 5).rows.count() == 0
    with pytest.raises(ValueError):
        vector_index.build_index(chunks.where("id = 0"), str(tmp_path / "none"))


def test_cells_equal_brute_force_and_score_few_vectors(monkeypatch):
    from siftstone.operators import cells

    random = np.random.default_rng(11)
    for size, count in ((4, 9000), (2, 5000), (16, 4500), (3, 0), (3, 40), (20, 5000)):
        vectors = random.normal(0, 1, (count, size))
        vectors[: count // 5] = vectors[:1]  # copies, which all tie
        vectors[count // 5 : count // 4] = 0
        norms = np.linalg.norm(vectors, axis=1)
        vectors = vectors / np.where(norms == 0, 1, norms)[:, None]
        codes = random.integers(0, 3, count)
        asks = random.normal(0, 1, (50, size))
        asks = np.concatenate((asks / np.linalg.norm(asks, axis=1)[:, None], vectors[:2], vectors[-20:], np.zeros((1, size)), np.full((1, size), np.nan)))
        held = cells.Cells(vectors, codes)
        assert (held.places is None) == (size > cells.CELL_SIZE or count < 4096)
        for scopes in (None, random.integers(-1, 3, len(asks))):
            for floor in (-np.inf, 0.95):
                row, place, score = held.best(asks, scopes, np.full(len(asks), floor), 5)
                for i, ask in enumerate(asks):
                    every = vectors @ ask
                    every[~((every >= floor) & ((scopes is None) | (codes == (0 if scopes is None else scopes[i]))))] = -np.inf
                    usable = np.sort(every[np.isfinite(every)])[-5:]
                    want = np.flatnonzero(np.isfinite(every) & (every >= usable[0] - 5e-10)) if len(usable) else []
                    got = place[row == i]
                    assert len(set(got.tolist())) == len(got) and set(want) <= set(got.tolist()) and (len(want) == 0) == (len(got) == 0)
                    assert np.allclose(score[row == i], every[got]) and (len(got) == 0 or score[row == i].min() >= usable[0] - 2e-9)
    vectors, scored, inside = random.normal(0, 1, (50_000, 4)), [], cells.Cells._inside
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    monkeypatch.setattr(cells.Cells, "_inside", lambda self, asks, *more: scored.append(len(more[-1]) * self.places.shape[1]) or inside(self, asks, *more))
    monkeypatch.setattr(cells.Cells, "_dense", None)
    row, _, score = cells.Cells(vectors, np.zeros(50_000, int)).best(vectors[:200], None, np.full(200, -np.inf), 8)
    assert sum(scored) < 0.1 * 200 * 50_000 and np.bincount(row).tolist() == [8] * 200


def test_short_vectors_hand_on_few_candidates(spark, tmp_path, monkeypatch):
    random = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v], f"d{i % 2}") for i, v in enumerate(random.normal(0, 1, (6000, 3)))]
    chunks = spark.createDataFrame(rows, "id long, embedding array<double>, dataset string")
    index = vector_index.build_index(chunks, str(tmp_path / "i"), 1, scope="dataset")
    queries = queries_of(spark, chunks, 200)
    handed, scored = [], vector_index._scored
    monkeypatch.setattr(vector_index, "_scored", lambda *a: handed.append(scored(*a)) or handed[-1])
    for scope in (None, "dataset"):
        found = rows_of(vector_index.search_index(index, queries, 5, None, scope=scope).rows)
        assert found == rows_of(retrieval.search_vectors(chunks, queries, 5, None, scope=scope)) and len(found) == 150
    assert all(h[0].count() <= 150 for h in handed)  # one byte a dimension let many more pass
