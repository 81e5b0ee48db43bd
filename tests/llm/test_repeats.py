import hashlib
import random

import numpy as np
import pytest
from llm.helpers import clashing, frame, prose

from siftstone.llm import common, repeats


def brute(rows, length=100):
    """Every string of the given length against all that start earlier."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            part = data[p : p + length]
            if part in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(part)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[doc] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def found(docs):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in repeats.remove_repeats(docs).collect()}


def planted():
    random_ = random.Random(7)
    passages = [prose(900 + i, 25) for i in range(6)]
    rows = []
    for i in range(60):
        text = prose(i, random_.randrange(2, 60))
        for _ in range(random_.randrange(3)):
            cut = random_.randrange(len(text) + 1)
            passage = random_.choice(passages)
            a = random_.randrange(30)
            text = text[:cut] + passage[a : a + random_.randrange(90, 160)] + text[cut:]
        rows.append((i, text))
    rows += [(100, rows[3][1]), (101, rows[3][1] + "!"), (102, None), (103, ""), (104, "x" * 99), (105, "x" * 100)]
    rows += [(106, "a" * 500), (107, "ab" * 300), (108, "ba" * 200), (109, "a" * 100 + "é" * 120), (110, "é" * 80 + "b" * 30)]
    return rows


def test_brute_force(spark):
    rows = planted()
    assert found(clashing(frame(spark, rows)).repartition(5)) == brute(rows)


def test_long_texts_in_pieces_and_small_buckets(spark, monkeypatch):
    """Buckets that end inside hot strings, and rows cut where pieces of a long text meet."""
    rows = planted()[:70] + [(200, prose(3, 400) + "c" * 400 + prose(3, 400))]
    monkeypatch.setattr(repeats, "BUCKET_ROWS", 40)
    monkeypatch.setattr(repeats, "text_pieces", lambda data, offsets, overlap: common.text_pieces(data, offsets, overlap, 150))
    assert found(frame(spark, rows)) == brute(rows)


def test_every_period(spark):
    """Repeats inside one document that no other one shares, at every distance up to beyond the length of a suffix."""
    rows = []
    for period in range(1, 151):
        random_ = random.Random(period)
        line = "".join(random_.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(period))
        rows.append((period, f"{random_.random()} {line * (300 // period + 2)} {random_.random()}"))
    # a line of 68 characters and a newline, from the first length at which a string comes twice
    line = "The quick brown fox jumps over the lazy dog, then goes home to sleep"
    rows += [(300 + n, (f"{line[:-3]}{n}\n" * 4)[:n]) for n in (168, 169, 170, 237, 238)]
    assert found(frame(spark, rows)) == brute(rows)


def test_odd_tables(spark):
    assert repeats.remove_repeats(frame(spark, [])).count() == 0
    text = prose(1, 50)
    rows = repeats.remove_repeats(frame(spark, [(1, text), (1, text), (None, text), (None, None), (1, "other")])).collect()
    assert len(rows) == 5
    # the null id comes first; repeated rows are one document
    assert sorted((r["doc_id"] is None, r["n_removed"] > 0) for r in rows) == [(False, False), (False, True), (False, True), (True, False), (True, False)]


@pytest.mark.parametrize("seed", range(5))
def test_multikey_order(seed):
    random_ = np.random.default_rng(seed)
    columns = [random_.integers(0, 4, 300) for _ in range(4)]
    order = repeats.multikey_order(columns)
    rows = list(zip(*(c[order].tolist() for c in columns)))
    assert rows == sorted(zip(*(c.tolist() for c in columns)))
    assert len(repeats.multikey_order([np.zeros(0, np.int64)] * 2)) == 0
