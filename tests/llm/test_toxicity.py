import random
import zlib

import numpy as np
from llm.helpers import clashing, frame, prose

from siftstone.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


def all_maximal(scores):
    """Maximal-scoring passages by their definition: no part scores more, and none of their extensions is itself of that kind."""
    n, total = len(scores), np.concatenate(([0.0], np.cumsum(scores)))

    def good(a, b):
        inner = [(total[j] - total[i]) for i in range(a, b) for j in range(i + 1, b + 1) if (i, j) != (a, b)]
        return total[b] - total[a] > 0 and all(total[b] - total[a] > v for v in inner)

    found = [(a, b) for a in range(n) for b in range(a + 1, n + 1) if good(a, b)]
    return sorted((a, b) for a, b in found if not any((c, d) != (a, b) and c <= a and b <= d for c, d in found))


def test_segments():
    random_ = random.Random(3)
    for _ in range(200):
        scores = np.array([random_.uniform(-3, 3) for _ in range(random_.randrange(1, 12))])
        total = np.concatenate(([0.0], np.cumsum(scores)))
        got = [(a, b) for a, b, _ in toxicity.segments(total, np.flatnonzero(scores > 0))]
        assert got == all_maximal(scores)


def test_tokens():
    data = "Ab,ab xÿ_1".encode()
    row, buckets = toxicity.token_buckets(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert len(row) == 4 and buckets[0, 0] == buckets[1, 0] != buckets[2, 0]


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(rows) > 500 and (rows.predicted == rows.toxic).mean() > 0.97
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) for i in rows.doc_id)
    toxic = rows.toxic == 1
    assert (rows.score[toxic].to_numpy()[:, None] > rows.score[~toxic].to_numpy()[None, :]).mean() > 0.98


def test_labels_of_the_held_out_fold_are_not_used(spark):
    rows = [(i, prose(i, 30) + (" vile" if i % 3 == 0 else "")) for i in range(400)]
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    true = [(i, int(i % 3 == 0)) for i, _ in rows]
    false = [(i, 1 - y if i in held else y) for i, y in true]
    docs = frame(spark, rows)
    found = [sorted(map(tuple, toxicity.toxicity(docs, spark.createDataFrame(y, "doc_id long, toxic int")).collect())) for y in (true, false)]
    assert found[0] == found[1]
    assert sum(p == int(i % 3 == 0) for i, _, _, p in found[0]) > 380


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(frame(spark, []), none).count() == 0
    rows = [(1, None), (2, ""), (3, "vile " * 50_000), (3, "vile"), (None, "vile"), (4, "x" * 300_000)]
    found = toxicity.toxicity(clashing(frame(spark, rows)), none).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in found)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(frame(spark, rows), labels).count() == len(rows)
    model = toxicity.fit(frame(spark, rows).select("doc_id", "text"), none)
    assert toxicity.keep_clean(clashing(frame(spark, rows)), model).count() == len(rows)
