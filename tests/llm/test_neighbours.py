import numpy as np
from llm.helpers import clashing

from siftstone.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>"
QUERY = "vec_id % 20 = 0"


def brute(rows, k=20):
    """All pairs, nearest first, ties to the smaller id."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % 20 == 0:
            ranked = sorted((-float((v * w).sum()), j) for j, w in good if j != i)
            out[i] = [(j, -s) for s, j in ranked[:k]]
    return out


def answers(vectors, k=20):
    out = {}
    for r in sorted(neighbours.nearest(vectors, QUERY, k).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def test_recall_and_scores(spark):
    random_ = np.random.default_rng(5)
    centres = random_.standard_normal((30, 24)) * 2
    data = centres[random_.integers(0, 30, 6_000)] + random_.standard_normal((6_000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    want, got = brute(rows), answers(clashing(spark.createDataFrame(rows, SCHEMA)))
    pairs = {(q, j) for q, own in want.items() for j, _ in own}
    found = {(q, j) for q, own in got.items() for j, _ in own}
    assert len(found & pairs) >= 0.9 * len(pairs) and len(found) == len(pairs)
    exact = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, own in got.items():
        assert all(abs(float((exact[q] * exact[j]).sum()) - s) < 1e-9 for j, s in own)
        assert own == sorted(own, key=lambda p: (-p[1], p[0]))


def test_equal_vectors_and_cells(spark, monkeypatch):
    """A third of all rows equal; cells of a few rows; ties go to the smaller ids."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 50)
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 7)
    random_ = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else random_.integers(-4, 5, 3).astype(float).tolist()) for i in range(900)]
    want, got = brute(rows), answers(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.keys() == want.keys()
    found = sum(a == b for q in want for a, b in zip(got[q], want[q]))
    assert found >= 0.9 * sum(map(len, want.values()))


def test_odd_tables(spark):
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), QUERY).count() == 0
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (20, [0.0, 0.0]), (40, [None, 1.0]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (3, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (5, [2.0, 1.0]), (5, [2.0, 1.0]), (100, [])]
    assert answers(spark.createDataFrame(rows, SCHEMA)) == {0: [(5, 2.0), (1, 0.0)]}
    assert answers(spark.createDataFrame([(0, [1.0])], SCHEMA)) == {}


def test_scan_keeps_the_nearest():
    random_ = np.random.default_rng(8)
    vectors, queries = random_.standard_normal((3_000, 65)).astype(np.float32), random_.standard_normal((10, 65)).astype(np.float32)
    far = ((vectors[None] - queries[:, None]) ** 2).sum(2)
    hits = sum(len(set(p) & set(np.argsort(d)[:20])) for p, d in zip(neighbours.scan(vectors, queries, 20), far))
    assert hits >= 0.95 * 200
