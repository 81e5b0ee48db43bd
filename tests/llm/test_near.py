import random
from collections import defaultdict

import numpy as np
from llm.helpers import clashing, frame, prose, shingles_of

from siftstone.llm import near, shingles
from siftstone.llm.components import connected


def brute(rows):
    sets, parent = {i: shingles_of(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def copies(seed, count, edits, words=120):
    random_ = random.Random(seed)
    base = prose(seed, words).split()
    out = []
    for _ in range(count):
        text = list(base)
        for _ in range(random_.randrange(edits + 1)):
            text[random_.randrange(len(text))] = f"edit{random_.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def planted():
    texts = [prose(i, 3 + i % 50) for i in range(60)]
    for seed, count, edits in ((500, 40, 6), (501, 12, 3), (502, 25, 9), (503, 3, 1)):
        texts += copies(seed, count, edits)
    texts += ["one", "ONE", "one  two", "one\ttwo", "ä Ä", "Ä ä", "", None, " \n ", "a b c d e", "a b c d e f", "a b c d e f g", texts[5], texts[5]]
    order = list(range(len(texts)))
    random.Random(9).shuffle(order)
    return [(3 * i + 1, texts[j]) for i, j in enumerate(order)]


def result(docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near.near_duplicates(docs).collect()}


def test_brute_force(spark):
    rows = planted()
    assert result(clashing(frame(spark, rows)).repartition(6)) == brute(rows)


def test_blocks(spark, monkeypatch):
    """Buckets and groups cut into several blocks."""
    monkeypatch.setattr(near, "BUCKET_BLOCK", 5)
    monkeypatch.setattr(near, "GROUP_BLOCK", 4)
    rows = planted()
    assert result(frame(spark, rows)) == brute(rows)


def test_threshold(spark):
    """Sets of 20, of which 15 of 20 in the union are shared, and one with less."""
    def text(words):
        return " ".join(words)

    base = [f"w{i}" for i in range(24)]
    rows = [(1, text(base)), (2, text(base[:19])), (3, text([f"v{i}" for i in range(24)])), (4, text([f"v{i}" for i in range(18)]))]
    assert len(shingles_of(rows[0][1])) == 20 and len(shingles_of(rows[1][1])) == 15
    assert result(frame(spark, rows)) == {1: (20, 1, True), 2: (15, 1, False), 3: (20, 3, True), 4: (14, 4, True)}


def test_odd_tables(spark):
    assert near.near_duplicates(frame(spark, [])).count() == 0
    text = prose(1, 40)
    rows = near.near_duplicates(frame(spark, [(1, text), (1, text), (None, text), (7, "w " * 50_000), (None, None)])).collect()
    assert len(rows) == 5
    kept = near.keep_one(clashing(frame(spark, [(1, text), (1, text), (None, text), (7, "other"), (8, None)])))
    assert kept.count() == 3 and "part" in kept.columns
    plain = near.keep_one(frame(spark, planted()))
    want = {i for i, v in brute(planted()).items() if v[2]}
    assert {r["doc_id"] for r in plain.collect()} == want


def test_estimate():
    random_ = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.75, 0.9):
        values = []
        for _ in range(30):
            a = random_.integers(0, 2**64, 2_000, dtype=np.uint64)
            same = int(2_000 * 2 * share / (1 + share))
            b = np.concatenate([a[:same], random_.integers(0, 2**64, 2_000 - same, dtype=np.uint64)])
            value, used = shingles.estimate(shingles.sketch(np.sort(a)), shingles.sketch(np.sort(b)))
            assert used == shingles.REGISTERS
            values.append(float(value))
        assert abs(np.mean(values) - share) < 0.03


def test_components(spark):
    random_ = random.Random(3)
    links = [(random_.randrange(400), random_.randrange(400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(90)] + [(2000, i) for i in range(2001, 2100)]
    parent = defaultdict(int, {n: n for pair in links for n in pair})

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    found = connected(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {n: root(n) for n in list(parent)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
