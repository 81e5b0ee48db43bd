import heapq
import math
import pickle
import random
import struct
import sys

import pytest
import sentencepiece
from llm.helpers import clashing, frame, prose

from siftstone.llm import pieces, queries

S = queries.vocabulary()


def all_paths(word):
    edges = S.edges(word)

    def upto(j):
        if not j:
            yield 0.0, ()
        for i, ids, score in edges[j]:
            for total, before in upto(i):
                yield total + score, before + ids

    return sorted(upto(len(word)), key=lambda p: -p[0])


def test_segments_against_all_paths():
    random_ = random.Random(1)
    for _ in range(300):
        word = pieces.SPACE + "".join(random_.choice(["th", "e", "in", "a", "s", "q", "ñ", "ß", "x", "你", "\n"]) for _ in range(random_.randint(0, 5)))
        paths, best = all_paths(word), S.n_best(word, 6)
        assert [round(s, 9) for s, _ in best] == [round(s, 9) for s, _ in paths[:6]]
        assert {ids for _, ids in best} <= {ids for _, ids in paths}
        ids, score, loss = S.solve(word)
        assert abs(score - paths[0][0]) < 1e-9
        assert loss == math.inf if len(paths) == 1 else abs(loss - (paths[0][0] - paths[1][0])) < 1e-9


def test_texts_against_the_whole_lattice():
    random_ = random.Random(2)
    for _ in range(300):
        text = " ".join("".join(random_.choice("abthe▁ñ你\n￾") for _ in range(random_.randint(0, 3))) for _ in range(random_.randint(1, 3)))
        ids, score, others = S.encode(text, 5)
        assert S.decode(ids) == text
        if text:
            word = pieces.SPACE + text.replace(pieces.SPACE, pieces.MARK).replace(" ", pieces.SPACE)
            want = S.n_best(word, 5)
            assert [round(v, 9) for v in (score, *(s for s, _ in others))] == [round(s, 9) for s, _ in want]
            for total, changes in others:
                own = list(ids)
                for at, count, instead in sorted(changes, reverse=True):
                    own[at : at + count] = instead
                assert S.decode(own) == text


def best_scores(word, n):
    """The ``n`` best scores of a segment, kept place by place."""
    edges, scores = S.edges(word), [[0.0]]
    for ending in edges[1:]:
        scores.append(heapq.nlargest(n, [before + score for start, _, score in ending for before in scores[start]]))
    return scores[-1]


@pytest.mark.parametrize("c", [pieces.SPACE, "}", "]", "c", "=", "-", "0"])
@pytest.mark.parametrize("size", [2, 7, 14, 201, 5_000])
def test_runs_of_one_character(c, size):
    """Orders of the same pieces tie; the search is as long as the run, not as the number of orders."""
    own = pieces.Segmenter(S.pieces, S.kinds, S.scores, pieces.Store())
    pops, pop = [0], heapq.heappop

    def counted(queue):
        pops[0] += 1
        assert pops[0] <= 64 * (size + 1)  # else it would not end
        return pop(queue)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pieces.heapq, "heappop", counted)
        found = own.n_best(c * size, 4)
    assert [s for s, _ in found] == pytest.approx(best_scores(c * size, 4), rel=1e-9)
    assert len({ids for _, ids in found}) == len(found)
    assert all("".join(S.pieces[i] for i in ids) == c * size for _, ids in found)


@pytest.mark.parametrize("text", ["a" + " " * 5_000 + "b", "}" * 5_000, "x = {" + " " * 300 + "}" * 300 + "]" * 300, "}" * 12, "c" * 4_003])
@pytest.mark.parametrize("n", [2, 4, 9])
def test_alternatives_differ(text, n):
    """Among ties too, every alternative is another segmentation than the best one, and than the others."""
    ids, score, others = S.encode(text, n)
    seen, last = {tuple(ids)}, score
    for total, changes in others:
        own = list(ids)
        for at, count, instead in sorted(changes, reverse=True):
            own[at : at + count] = instead
        assert S.decode(own) == text
        assert sum(S.scores[i] for i in own) == pytest.approx(total, rel=1e-9)
        assert total <= last + 1e-9
        seen.add(tuple(own))
        last = total
    assert len(seen) == n


def _field(number, wire, value):
    tag = bytes([number << 3 | wire])
    if wire == 2:
        size, out = len(value), b""
        while size > 127:
            out, size = out + bytes([size & 127 | 128]), size >> 7
        return tag + out + bytes([size]) + value
    return tag + value


@pytest.fixture(scope="module")
def unigram():
    """The same vocabulary and scores as a unigram model of the library."""
    body = b""
    for piece, kind, score in zip(S.pieces, S.kinds, S.scores):
        body += _field(1, 2, _field(1, 2, piece.encode()) + _field(2, 5, struct.pack("<f", score)) + _field(3, 0, bytes([kind])))
    body += _field(2, 2, _field(3, 0, b"\x01") + b"\x98\x02\x01")  # unigram; byte fallback
    body += _field(3, 2, _field(1, 2, b"identity") + _field(3, 0, b"\x01") + _field(4, 0, b"\x00") + _field(5, 0, b"\x01"))
    return sentencepiece.SentencePieceProcessor(model_proto=body)


def test_best_scores_against_the_library(unigram):
    for i in range(40):
        text = prose(i, 6) + " tokenization of the world"
        ids, score, _ = S.encode(text, 1)
        other = unigram.encode(text)
        assert abs(sum(S.scores[j] if S.kinds[j] != pieces.BYTE else 0 for j in other) - sum(S.scores[j] if S.kinds[j] != pieces.BYTE else 0 for j in ids)) < 1e-2


def test_table(spark):
    rows = [(1, "Hello  world"), (2, None), (3, ""), (4, " leading and trailing "), (4, " leading and trailing "), (None, "▁ \t\n"), (5, "x" * 100_000), (6, "你好" * 50)]
    found = pieces.encode_documents(clashing(frame(spark, rows)), S).collect()
    assert len(found) == len(rows) and all(r["restored"] for r in found)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[2]["ids"] == [] and by_id[3]["alternatives"] == []
    assert len(by_id[1]["alternatives"]) == pieces.BEST - 1
    scores = [by_id[1]["score"], *(a["score"] for a in by_id[1]["alternatives"])]
    assert scores == sorted(scores, reverse=True)
    assert pieces.encode_documents(frame(spark, []), S).count() == 0


def test_stores_do_not_change_results(monkeypatch):
    texts = [prose(i, 80) for i in range(10)]
    want = [S.encode(t) for t in texts]
    monkeypatch.setattr(pieces, "REMEMBERED", 7)
    assert [pieces.Segmenter(S.pieces, S.kinds, S.scores, pieces.Store()).encode(t) for t in texts] == want


def test_many_words_at_once():
    """The same results as one by one."""
    own = pieces.Segmenter(S.pieces, S.kinds, S.scores, pieces.Store())
    words = list({w for i in range(30) for w in S.words(prose(i, 60) + " naïve 你好x 🙂a ▁ \n Ünïcode" + "zq" * i)} | {"▁", "🙂", "a"})
    assert own.solve_many(words) == [S.solve(w) for w in words]
    assert own.solve_many([]) == []


def test_new_words_take_few_calls():
    """New words of all lengths are solved together, not length by length or word by word."""
    random_ = random.Random(9)
    texts = [" ".join("".join(random_.choice("etaoinshr") for _ in range(random_.randint(2, 40))) for _ in range(300)) for _ in range(20)]
    own = pieces.Segmenter(S.pieces, S.kinds, S.scores, pieces.Store())
    own.encode_many([prose(1, 5)])  # makes the arrays of the tree
    calls = [0]

    def counted(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(counted)
    try:
        own.encode_many(texts, 1)
    finally:
        sys.setprofile(None)
    words = {w for t in texts for w in S.words(t)}
    assert calls[0] < 5 * len(words)


def test_a_full_store_keeps_the_words_used_most(monkeypatch):
    texts = [f"the and {'a' * (i + 2)} {'b' * (i + 2)}" for i in range(30)]
    want = [S.encode(t) for t in texts]
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    own, solved = pieces.Segmenter(S.pieces, S.kinds, S.scores, pieces.Store()), []
    monkeypatch.setattr(pieces.Segmenter, "_solved", lambda self, words, f=pieces.Segmenter._solved: solved.extend(words) or f(self, words))
    assert [own.encode(t) for t in texts] == want
    assert solved.count(pieces.SPACE + "the") == 1 and len(own.store.number) == len(own.store.sizes) < 24


def test_words_of_an_interrupted_call_are_solved_by_the_next_one(monkeypatch):
    own = pieces.Segmenter(S.pieces, S.kinds, S.scores, pieces.Store())
    with monkeypatch.context() as patch:
        patch.setattr(pieces.Segmenter, "_solved", lambda self, words: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            own.encode("some words")
    assert own.encode("other words") == S.encode("other words")


def test_other_operators_tasks_drop_the_kept_segmenters():
    from siftstone.llm import common

    segmenter = pickle.loads(pickle.dumps(pieces.Segmenter(["<unk>", "a", "b"], [pieces.UNKNOWN, pieces.NORMAL, pieces.NORMAL], [0.0, -1.0, -2.0])))
    assert segmenter in pieces._SEGMENTERS.values()
    assert list(common.tidy(iter, "pieces")([1])) == [1] and segmenter in pieces._SEGMENTERS.values()
    assert list(common.tidy(iter)([1])) == [1] and not pieces._SEGMENTERS
