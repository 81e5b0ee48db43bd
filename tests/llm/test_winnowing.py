import hashlib

import numpy as np
import pytest
from llm.helpers import clashing, frame, prose

from siftstone.llm import common, winnowing


def brute(data: bytes, k, w):
    """Windows one by one."""
    codes = common.byte_codes(winnowing.SEED)
    arr = np.frombuffer(data, np.uint8)
    if not len(arr):
        return set()
    k = min(k, len(arr))
    h = common.mixed(common.gram_hashes(codes[arr], k)).tolist()
    out = set()
    for i in range(max(1, len(h) - w + 1)):
        window = h[i : i + w]
        low = min(window)
        place = max(j for j, v in enumerate(window) if v == low)
        out.add((low, i + place))
    return out


@pytest.mark.parametrize("text", ["", "a", "short", "aaaa" * 60, prose(1, 80), "é" * 50, "x" * 59, "x" * 58, "ab" * 30])
def test_windows(text):
    data = text.encode()
    row, value, place = winnowing.winnow(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert set(zip(value.tolist(), place.tolist())) == brute(data, winnowing.GRAM, winnowing.WINDOW)


def test_a_long_text_is_cut_into_pieces_without_a_trace(monkeypatch):
    data = prose(3, 3000).encode()
    whole = winnowing.winnow(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    monkeypatch.setattr(common.text_pieces, "__defaults__", (300,))
    pieces = winnowing.winnow(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert all(np.array_equal(a, b) for a, b in zip(whole, pieces))


def test_match_guarantee():
    shared = prose(5, 30)[: winnowing.GRAM + winnowing.WINDOW - 1].encode()
    marks = []
    for side in (b"one side " * 20, b"another " * 30):
        data = side + shared + side
        _, value, _ = winnowing.winnow(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        marks.append(set(value.tolist()))
    assert marks[0] & marks[1]


def expected(rows):
    order = sorted(rows, key=lambda r: r[0])
    out = {}
    for i, (doc, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest())
    return out


def test_edited_texts(spark):
    rows = [(i * 7 % 101, prose(i, 5 + i % 40)) for i in range(101)]
    rows[3] = (rows[3][0], None)
    rows[9] = (rows[9][0], "")
    rows[20] = (rows[20][0], rows[40][1])
    found = winnowing.edited_fingerprints(clashing(frame(spark, rows)).repartition(7)).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in found} == expected(rows)
    by_text = {}
    for r in found:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text.setdefault(dict(rows)[r["doc_id"]] or "", set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len(set().union(*by_text.values())) == len(by_text)


def test_odd_tables(spark):
    assert winnowing.edited_fingerprints(frame(spark, [])).count() == 0
    (only,) = winnowing.edited_fingerprints(frame(spark, [(1, "alone in the table")])).collect()
    assert only["near_next"] == 1 and only["n_chars"] == 18
    repeated = winnowing.edited_fingerprints(frame(spark, [(1, "same"), (1, "same"), (None, "no id"), (None, None), (2, "x" * 300_000)]))
    assert repeated.count() == 5
    assert winnowing.fingerprints(frame(spark, [(1, None), (2, "some text")])).count() == 2
