from collections import Counter, defaultdict
from math import comb

import pytest
from llm.helpers import clashing, frame, prose, words_of
from pyspark.sql import functions as F

from siftstone.llm import mixing


def expected_targets(sizes):
    """Give by weight, take back what is over, again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            return {**out, **share}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def documents():
    rows = [(i, prose(i, 1 + i * 13 % 90), ["b", "a", "hot", "hot", None, "é", "Z"][i % 7]) for i in range(300)]
    return rows + [(400, None, "a"), (401, "", "empty"), (402, prose(1, 3_000), "é"), (402, prose(1, 3_000), "é"), (None, "no id here", "b")]


def test_targets_and_taken(spark):
    rows = documents()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(words_of(text))
    found = mixing.taken_words(clashing(frame(spark, rows))).collect()
    again = mixing.taken_words(frame(spark, rows).repartition(9)).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))
    goals, taken, by_size = expected_targets(sizes), defaultdict(int), defaultdict(set)
    sources = defaultdict(set)
    for i, text, source in rows:
        sources[i, len(words_of(text))].add(source)
    assert len(found) == len(rows)
    for r in found:
        (source,) = sources[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(goals[source])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - goals[s]) <= 0.5 for s in sizes), (taken, goals)


def test_hypergeometric(spark):
    k, n, m, points = 7, 30, 12, 4_000
    drawn = spark.range(points).select(mixing.hypergeometric(F.lit(k).cast("long"), F.lit(n).cast("long"), F.lit(m).cast("long"), (F.col("id") + 0.5) / points).alias("x"))
    counts = {r["x"]: r["count"] for r in drawn.groupBy("x").count().collect()}
    for x in range(8):
        assert abs(counts.get(x, 0) / points - comb(k, x) * comb(n - k, m - x) / comb(n, m)) < 2 / points
    ends = spark.createDataFrame([(0, 5, 3), (5, 5, 3), (4, 9, 9), (2, 9, 0), (10**6, 10**9, 10**8)], "k long, n long, m long")
    values = [r[0] for r in ends.select(mixing.hypergeometric(F.col("k"), F.col("n"), F.col("m"), F.lit(0.5))).collect()]
    assert values[:4] == [0, 3, 4, 0] and abs(values[4] - 10**5) < 500


def test_shards(spark):
    rows = documents()
    totals, _, draws = mixing.draw(frame(spark, rows).withColumn("size", mixing.word_count(F.col("text"))).select("doc_id", "source", "size"), shards=8)
    draws = draws.collect()
    assert len({(r["source"], r["place"], r["pass"]) for r in draws}) == len(draws)
    per_shard = defaultdict(list)
    for r in draws:
        per_shard[r["shard"]].append(r["position"])
    assert len(per_shard) == 8 and all(sorted(p) == list(range(1, len(p) + 1)) for p in per_shard.values())
    counts = [len(p) for p in per_shard.values()]
    assert max(counts) - min(counts) <= 1
    # a source's places in permuted order fill the shards one after another
    for source in {r["source"] for r in draws}:
        own = sorted((r["pass"], r["place"], r["shard"]) for r in draws if r["source"] == source)
        assert [s for _, _, s in own] == sorted(s for _, _, s in own)


def test_mixed_documents(spark):
    rows = documents()
    docs = clashing(frame(spark, rows))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert max(copies.values()) <= 4 and 401 not in copies  # the repeated row twice each
    assert mixing.mixed_documents(frame(spark, [])).count() == 0 and mixing.taken_words(frame(spark, [])).count() == 0
    alone = mixing.taken_words(frame(spark, [(1, None), (2, "")])).collect()
    assert [r["taken"] for r in alone] == [0, 0]
