import random
import re
from collections import Counter

import pytest
from llm.helpers import _LOWER, clashing, frame

from siftstone.llm import common, phrases


def brute(docs, longest=3, least=10, first=2000):
    """The definition on a list of (lang, text)."""
    counts, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(_LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    candidates = {p: n for p, n in counts.items() if len(p) > 2 and n >= least}
    covered = Counter()
    for p, n in candidates.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                inner = (p[0], *p[i : i + k])
                covered[inner] = max(covered[inner], n)
    rows = []
    for p, a in candidates.items():
        if 100 * covered[p] < 50 * a:
            lang, w = p[0], p[1:]
            cuts = [(10**6 * a * a // (counts[(lang, *w[:k])] * counts[(lang, *w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.append((lang, " ".join(w), a, counts[(lang, *w[:k])], counts[(lang, *w[k:])], total[lang], score))
    rows.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    place, out = Counter(), []
    for r in rows:
        place[r[0]] += 1
        if place[r[0]] <= first:
            out.append((r[0], place[r[0]], *r[1:]))
    return out


def texts(seed, count=120):
    random_ = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "É", "a", "b", "c'd", "x\xa0y", "long" * 9]
    joins = [" ", " ", " ", " ", "  ", "\t", ", ", ". ", "\n", " !", ";"]
    return [
        (random_.choice(["en", "de", None, "und", ""]), "".join(random_.choice(vocabulary) + random_.choice(joins) for _ in range(random_.randrange(60))))
        for _ in range(count)
    ]


def found(spark, docs, **parameters):
    rows = spark.createDataFrame([(i, t, lang, "s", 0) for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars int")
    return sorted(map(tuple, phrases.collocations(clashing(rows).repartition(5), **parameters).collect()))


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_brute_force(spark, longest):
    docs = texts(longest)
    rows = brute(docs, longest, least=3)
    assert found(spark, docs, longest=longest, least=3) == rows and len(rows) > 50


def test_small_groups_and_ranges(spark, monkeypatch):
    """Long texts in parts, many flushes, a full bitmap, and streams cut into many ranges give the same."""
    docs = texts(11, 60) + [("en", "the of a b " * 300 + ". " + "a the " * 300)] * 2
    rows = brute(docs, least=3, first=40)
    monkeypatch.setattr(phrases, "FLUSH_WORDS", 50)
    monkeypatch.setattr(phrases, "RANGE_ROWS", 12)
    monkeypatch.setattr(phrases, "LEAST_BITS", 15)
    monkeypatch.setattr(phrases, "MOST_BITS", 15)
    batches = phrases.row_groups
    monkeypatch.setattr(phrases, "row_groups", lambda offsets: batches(offsets, 64))
    monkeypatch.setattr(phrases, "word_pieces", lambda data, offsets, separator: common.word_pieces(data, offsets, separator, 40))
    assert found(spark, docs, least=3, first=40) == rows


def test_large_counts():
    """Products beyond 64 bits are exact, ties go to the first cut."""
    import pyarrow as pa

    a = 2**40 + 1
    columns = [[b"x" * 16, b"x" * 24, b"x" * 24], [a, 10, 10], [[a + 1], [10, 20], [5, 10]], [[a + 2], [20, 10], [10, 20]]]
    (out,) = phrases._scores([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "n", "parts", "rest"])])
    assert out.column("score").to_pylist() == [10**6 * a * a // ((a + 1) * (a + 2)), 250_000, 10**6]
    assert list(zip(out.column("l").to_pylist(), out.column("r").to_pylist())) == [(a + 1, a + 2), (20, 20), (5, 20)]


def test_odd_tables(spark):
    assert phrases.collocations(frame(spark, [])).count() == 0
    odd = [(None, None), (None, ""), ("en", " .,\n"), ("und", "a b"), (None, "A b"), ("en", "x" * 300_000)]
    assert found(spark, odd) == []
    assert found(spark, odd, least=2) == [("und", 1, "a b", 2, 2, 2, 4, 10**6)]
    repeated = [("en", "one two three four")] * 12
    assert found(spark, repeated) == brute(repeated)
