"""Encoding texts in the pieces of a SentencePiece vocabulary, with the N best segmentations.

The lattice of a text has an edge for every piece that occurs in it, and a fallback edge of bytes for a character
that is no piece. A forward Viterbi pass gives the best score up to each place; searching backward from the end, A-star takes these
as exact estimates of what is left, so every path that it completes is the next best one. At places that no piece spans, all
segmentations meet. The lattice is cut there, and the segments' lists are combined by the same search over the segments
in which a second choice costs least.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from dataclasses import dataclass, field
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, byte_buffer, flat_ranges, row_groups, tidy

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Stands for a space mark that is in the text itself; half a surrogate pair, which no text has.
MARK = "\ud800"
#: An unknown character scores so much below the lowest piece.
UNKNOWN_PENALTY = 10.0
BEST = 4
#: Segments that a task's store remembers, about, which bounds its memory; and of how many it keeps N-best lists.
REMEMBERED, LISTED = 200_000, 8_000
#: Words of several characters that are solved at once, at most.
TOGETHER = 4_096
#: Texts of about so many bytes are cut into words and solved together.
SLICE_BYTES = 1 << 20


def read_vocabulary(path: str) -> tuple[list[str], list[int]]:
    """Pieces and their types of a model file (read on the driver; the pieces travel to the tasks)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]

    def kind(i):
        for found, name in ((model.is_unknown(i), UNKNOWN), (model.is_control(i), CONTROL), (model.is_unused(i), UNUSED), (model.is_byte(i), BYTE)):
            if found:
                return name
        return NORMAL

    return pieces, [kind(i) for i in range(len(pieces))]


def rank_scores(kinds: list[int]) -> list[float]:
    """Scores of a vocabulary that is only ordered, as merge vocabularies are: log probabilities falling off as 1 / rank."""
    total = sum(1 / r for r in range(1, kinds.count(NORMAL) + 1))
    out, rank = [], 0
    for kind in kinds:
        rank += kind == NORMAL
        out.append(-math.log(rank * total) if kind == NORMAL else 0.0)
    return out


def _zeros(kind):
    return field(default_factory=lambda: np.zeros(0, kind))


@dataclass
class Store:
    """Solved segments, numbered in the order in which they came, and N-best lists.

    A segment that is looked up in ``number`` gets the next number there; its ids are ``sizes`` ones of ``flat`` from ``starts`` on.
    """

    number: dict = field(default_factory=lambda: defaultdict(count().__next__))
    uses: np.ndarray = _zeros(np.int64)
    starts: np.ndarray = _zeros(np.int64)
    sizes: np.ndarray = _zeros(np.int64)
    flat: np.ndarray = _zeros(np.int32)
    score: np.ndarray = _zeros(np.float64)
    loss: np.ndarray = _zeros(np.float64)
    lists: dict = field(default_factory=dict)

    def add(self, sizes, flat, score, loss) -> None:
        """What belongs to the next numbers."""
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.uses = np.concatenate((self.uses, np.zeros(len(sizes), np.int64)))
        self.sizes, self.flat = np.concatenate((self.sizes, sizes)), np.concatenate((self.flat, flat))
        self.score, self.loss = np.concatenate((self.score, score)), np.concatenate((self.loss, loss))

    def shrink(self, most: int) -> None:
        """Forgets all but the ``most`` segments that were used most, where earlier uses count half."""
        kept = np.sort(np.argpartition(self.uses, len(self.uses) - most)[len(self.uses) - most :])
        words = list(self.number)
        self.number = defaultdict(count(len(kept)).__next__, zip([words[k] for k in kept.tolist()], range(len(kept))))
        self.flat = self.flat[flat_ranges(self.starts[kept], self.sizes[kept])]
        self.uses, self.sizes, self.score, self.loss = self.uses[kept] // 2, self.sizes[kept], self.score[kept], self.loss[kept]
        self.starts = np.cumsum(self.sizes) - self.sizes


#: A worker process keeps one segmenter per vocabulary, with its store, across its tasks; tasks of other operators drop it.
_SEGMENTERS: dict[int, "Segmenter"] = KEPT.setdefault("pieces", {})


def _segmenter(pieces: list[str], kinds: list[int], scores: list[float]) -> "Segmenter":
    key = hash((*pieces, *kinds, *scores))
    if key not in _SEGMENTERS:
        _SEGMENTERS[key] = Segmenter(pieces, kinds, scores)
    return _SEGMENTERS[key]


@dataclass
class Segmenter:
    """A vocabulary with scores, and what follows from it."""

    pieces: list[str]
    kinds: list[int]
    scores: list[float]
    store: Store = field(default_factory=Store, repr=False)
    _table: tuple | None = field(default=None, repr=False)

    def __post_init__(self):
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        #: A tree of characters: each leads to (tree, ids, score); what only begins a piece has no score.
        self.tree: dict = {}
        for i in usable:
            node, piece = self.tree, self.pieces[i]
            for c in piece[:-1]:
                node = node.setdefault(c, ({}, None, None))[0]
            node[piece[-1]] = (node.get(piece[-1], ({},))[0], (i,), self.scores[i])
        # bytes above 127 decode through the code points that stand for them in undecodable input
        self.shown = ["" if k in (UNKNOWN, CONTROL, UNUSED) else p.replace(SPACE, " ") for p, k in zip(self.pieces, self.kinds)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        for b, i in self.bytes.items():
            self.shown[i] = chr(b) if b < 128 else chr(0xDC00 + b)
        self.unknown_score = min(self.scores[i] for i in usable) - UNKNOWN_PENALTY
        self.longest = max(len(self.pieces[i]) for i in usable)
        self.unknown_id = self.kinds.index(UNKNOWN)
        # characters that stand beside another one in some piece; a space mark only ever begins one, or stands among its like
        beside = {c for i in usable if len(self.pieces[i]) > 1 for c in self.pieces[i]} - {SPACE}
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in usable):
            raise ValueError("a piece with a space mark inside it: segments cannot be cut at spaces")
        members = "".join(re.escape(c) for c in sorted(beside))
        self.segments = re.compile(f"{SPACE}+[{members}]*|[{members}]+|." if members else f"{SPACE}+|.", re.DOTALL)

    def __reduce__(self):
        return _segmenter, (self.pieces, self.kinds, self.scores)

    def edges(self, word: str) -> list[list[tuple[int, tuple, float]]]:
        """For each place the edges that end there: (start, ids, score)."""
        out = [[] for _ in range(len(word) + 1)]
        for i, c in enumerate(word):
            alone, node = False, self.tree
            for j in range(i + 1, len(word) + 1):
                if word[j - 1] not in node:
                    break
                node, ids, score = node[word[j - 1]]
                if score is not None:
                    out[j].append((i, ids, score))
                    alone |= j == i + 1
            if not alone:
                out[i + 1].append((i, self.fallback(c), self.unknown_score))
        return out

    def fallback(self, c: str) -> tuple:
        """The byte pieces of a character, or the unknown piece."""
        raw = (SPACE if c == MARK else c).encode()
        return tuple(self.bytes[b] for b in raw) if self.bytes else (self.unknown_id,)

    @staticmethod
    def forward(edges) -> list[float]:
        """Best score up to each place."""
        best = [0.0]
        for ending in edges[1:]:
            best.append(max(best[i] + score for i, _, score in ending) if ending else -math.inf)
        return best

    def solve(self, word: str) -> tuple[tuple, float, float]:
        """Best ids, their score, and how much the second-best segmentation loses (infinite, if there is none).

        The forward pass with two scores per place; of equals the first edge found stays.
        """
        size, tree = len(word), self.tree
        best, second, last = [0.0] + [-math.inf] * size, [-math.inf] * (size + 1), [None] * (size + 1)
        for i in range(size):
            here, next_, node, j = best[i], second[i], tree, i
            alone = False
            for c in word[i : i + self.longest]:
                if c not in node:
                    break
                node, ids, score = node[c]
                j += 1
                if score is None:
                    continue
                total = here + score
                if total > best[j]:
                    other = next_ + score
                    second[j] = other if other > best[j] else best[j]
                    best[j], last[j] = total, (i, ids)
                elif total > second[j]:
                    second[j] = total
                if j == i + 1:
                    alone = True
            if not alone:
                best[i + 1], second[i + 1], last[i + 1] = self._other(here, next_, best[i + 1], second[i + 1], last[i + 1], i, word[i])
        ids, j = [], size
        while j:
            j, own = last[j]
            ids.append(own)
        found = tuple([x for part in reversed(ids) for x in part]), best[size], best[size] - second[size]
        return found

    def recall(self, words, many: int) -> np.ndarray:
        """Numbers in the store of ``many`` words. Those that are new to it are solved; when it is full, the words used least go first."""
        store = self.store
        if len(store.sizes) >= REMEMBERED:
            store.shrink(REMEMBERED // 2)
        numbers = np.fromiter(map(store.number.__getitem__, words), np.int64, many)
        if len(store.number) > len(store.sizes):
            store.add(*self._solved(list(islice(store.number, len(store.sizes), None))))
        store.uses += np.bincount(numbers, minlength=len(store.uses))
        return numbers

    def _other(self, here, next_, best, second, last, i, c):
        """The fallback edge of a character, weighed against what has reached the place after it."""
        score = here + self.unknown_score
        if score > best:
            return score, max(best, next_ + self.unknown_score), (i, self.fallback(c))
        return best, max(second, score), last

    def _arrays(self):
        """The tree as arrays, for the characters that can stand in a word of several: next state per (inner state, character class), score and id."""
        if self._table is None:
            chars = sorted({c for p, k in zip(self.pieces, self.kinds) if k in (NORMAL, USER) and len(p) > 1 for c in p if ord(c) < 1 << 16})
            classes = np.zeros(1 << 16, np.int32)
            classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
            # state 0 is dead, state 1 the root; only states with children have a row of their own
            todo, rows, row, score, ids = [(self.tree, 1)], [np.zeros(len(chars) + 1, np.int32)], [0, 0], [-math.inf, -math.inf], [-1, -1]
            for node, state in todo:  # grows while it runs
                own = np.zeros(len(chars) + 1, np.int32)
                row[state] = len(rows)
                rows.append(own)
                for c, (below, piece, value) in node.items():
                    if ord(c) < 1 << 16 and classes[ord(c)]:
                        own[classes[ord(c)]] = len(row)
                        if below:
                            todo.append((below, len(row)))
                        row.append(0)
                        score.append(-math.inf if value is None else value)
                        ids.append(-1 if value is None else piece[0])
            kind = np.min_scalar_type(len(row))
            self._table = classes, np.stack([r.astype(kind) for r in rows]), np.array(row), np.array(score), np.array(ids)
        return self._table

    def solve_many(self, words: list[str]) -> list[tuple]:
        """``solve`` for many words at once."""
        sizes, flat, score, loss = self._solved(words)
        ids, ends = flat.tolist(), np.cumsum(sizes).tolist()
        return [(tuple(ids[end - size : end]), *values) for size, end, *values in zip(sizes.tolist(), ends, score.tolist(), loss.tolist())]

    def _solved(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``solve`` for many words: how many ids each has, all ids one after another, scores and losses.

        The same pass over places, each step for many words of about the same length together.
        """
        many, score, loss = np.zeros(len(words), np.int64), np.zeros(len(words)), np.zeros(len(words))
        parts, alone = [], np.ones(len(words), bool)
        if words:
            classes = self._arrays()[0]
            points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
            sizes = np.array([len(w) for w in words])
            starts = np.cumsum(sizes) - sizes
            known = np.where(points < 1 << 16, classes[np.minimum(points, (1 << 16) - 1)], 0)
            plain = np.flatnonzero(np.logical_and.reduceat(known > 0, starts) & (sizes > 1))
            plain = plain[np.argsort(-sizes[plain], kind="stable")]
            at, falling = 0, -sizes[plain]
            while at < len(plain):
                size = -int(falling[at])
                # words of more than half that length, as many as fit about the cells of TOGETHER words of 64 characters
                end = min(at + max(1, min(TOGETHER, (TOGETHER << 6) // size)), int(np.searchsorted(falling, -(size // 2), "left")))
                few, at = plain[at:end], end
                if len(few) < 16:  # steps for so few words cost more than one by one
                    continue
                place = np.arange(size)[:, None]
                inside = place < sizes[few]
                codes = np.where(inside, known[np.where(inside, starts[few] + place, 0)], 0)
                own_many, ids, own_score, own_loss, whole = self._solve_together(codes, sizes[few])
                parts.append((few[whole], own_many[whole], ids[np.repeat(whole, own_many)]))
                many[few], score[few], loss[few], alone[few] = own_many, own_score, own_loss, ~whole
        for k in np.flatnonzero(alone).tolist():
            ids, score[k], loss[k] = self.solve(words[k])
            many[k] = len(ids)
            parts.append((np.array([k]), many[k : k + 1], ids))
        first, flat = np.cumsum(many) - many, np.zeros(many.sum(), np.int32)
        for few, own_many, ids in parts:
            flat[flat_ranges(first[few], own_many)] = ids
        return many, flat, score, loss

    def _solve_together(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Words of falling length; ``codes`` has a row per place, with 0 behind a word's end.

        How many ids each word has, all ids, scores, losses, and whether no character took the fallback, whose ids are not given.
        """
        _, table, row, value_of, piece_of = self._arrays()
        (longest, n), width, codes_flat, table_flat = codes.shape, table.shape[1], codes.ravel(), table.ravel()
        below = row * width
        # place by place, all words of each
        best, second = np.full((longest + 1) * n, -math.inf), np.full((longest + 1) * n, -math.inf)
        back, last = np.zeros((longest + 1) * n, np.int32), np.full((longest + 1) * n, -1, np.int32)
        best[:n] = 0.0
        reach = np.searchsorted(-sizes, -np.arange(longest), "left").tolist()
        for i, m in enumerate(reach):
            here, next_ = best[i * n : i * n + m], second[i * n : i * n + m]
            state = table_flat.take(below[1] + codes[i, :m])
            ids, to = piece_of.take(state), slice((i + 1) * n, (i + 1) * n + m)
            value = np.where(ids < 0, self.unknown_score, value_of.take(state))
            total, old = here + value, best[to]
            better = total > old
            second[to] = np.where(better, np.maximum(old, next_ + value), np.maximum(second[to], total))
            best[to] = np.where(better, total, old)
            np.copyto(back[to], i, where=better)
            np.copyto(last[to], ids, where=better, casting="same_kind")
            at = below.take(state)
            alive = np.flatnonzero(at)
            at = at[alive]
            for j in range(i + 2, min(longest, i + self.longest) + 1):
                if not len(alive):
                    break
                state = table_flat.take(at + codes_flat.take((j - 1) * n + alive))
                ids = piece_of.take(state)
                chosen = np.flatnonzero(ids >= 0)
                if len(chosen):
                    who, ids, value = alive[chosen], ids[chosen], value_of.take(state[chosen])
                    to = j * n + who
                    total, old = here.take(who) + value, best.take(to)
                    better = total > old
                    second[to] = np.where(better, np.maximum(old, next_.take(who) + value), np.maximum(second.take(to), total))
                    to = to[better]
                    best[to], back[to], last[to] = total[better], i, ids[better]
                at = below.take(state)
                going = np.flatnonzero(at)
                alive, at = alive[going], at[going]
        # all paths at once, from their ends: how many pieces each has, then the pieces in their places
        everyone = np.arange(n)
        many, whole, steps, at, alive = np.zeros(n, np.int64), np.ones(n, bool), [], sizes, everyone
        while len(alive):
            place = at * n + alive
            ids, at = last.take(place), back.take(place)
            steps.append((alive, ids))
            many[alive] += 1
            whole[alive[ids < 0]] = False
            going = at > 0
            alive, at = alive[going], at[going]
        ends = np.cumsum(many)
        flat = np.empty(many.sum(), np.int32)
        for k, (alive, ids) in enumerate(steps):
            flat[ends[alive] - 1 - k] = ids
        top = best.take(sizes * n + everyone)
        return many, flat, top, top - second.take(sizes * n + everyone), whole

    def n_best(self, word: str, n: int) -> list[tuple[float, tuple]]:
        """The ``n`` best segmentations of one segment: (score, ids), best first."""
        known = self.store.lists.get((word, n))
        if known is not None:
            return known
        edges = self.edges(word)
        best = self.forward(edges)
        # of equal totals the place nearest to the start is opened first, so that ties do not keep a path from being completed;
        # the n best paths from a place to the end are all that can be in the n best ones, so others are neither opened nor queued
        queue, count, out = [(-best[-1], len(word), 0, 0.0, ())], 0, []
        opened, nearest = [0] * len(edges), [[] for _ in edges]
        while queue and len(out) < n:
            _, at, _, done, ids = heapq.heappop(queue)
            if at == 0:
                out.append((done, _flat(ids)))
                continue
            if opened[at] == n:
                continue
            opened[at] += 1
            for start, own, score in edges[at]:
                after, held = done + score, nearest[start]
                if len(held) < n:
                    heapq.heappush(held, after)
                elif after > held[0]:
                    heapq.heapreplace(held, after)
                else:
                    continue
                count += 1
                heapq.heappush(queue, (-(best[start] + after), start, count, after, (own, ids)))
        out.sort(key=lambda found: -found[0])  # equal up to rounding, they may come in any order
        if len(self.store.lists) >= LISTED:
            self.store.lists.clear()
        self.store.lists[word, n] = out
        return out

    def words(self, text: str) -> list[str]:
        """The segments of a text, with the space mark that SentencePiece puts in front."""
        return self.segments.findall(SPACE + text.replace(SPACE, MARK).replace(" ", SPACE)) if text else []

    def encode(self, text: str, n: int = BEST):
        """Ids of the best segmentation, its score, and of the next best ones (score, [(first token, tokens, ids instead)])."""
        ids, cuts, scores, others = self.encode_many([text], n)
        return ids.tolist(), scores[0], others[0]

    def encode_many(self, texts: list[str], n: int = BEST):
        """``encode`` of several texts: all ids one after another, the cuts between the texts, scores, and the next best segmentations."""
        words, store = [self.words(t) for t in texts], self.store
        ends = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        all_words = self.recall(chain.from_iterable(words), ends[-1])
        own_sizes = store.sizes[all_words]
        before = np.concatenate(([0], np.cumsum(own_sizes)))
        ids = store.flat[flat_ranges(store.starts[all_words], own_sizes)]
        value, loss = store.score[all_words], store.loss[all_words]
        scores, others = [], []
        for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            scores.append(float(value[a:b].sum()))
            others.append([] if n < 2 else self._others(words[k], ids, loss[a:b], before[a : b + 1], scores[-1], n))
        return ids, before[ends], scores, others

    def _others(self, words, ids, losses, before, score, n):
        """The next best segmentations of one text."""
        # only the n - 1 segments with the least loss can differ in the n best ones
        chosen = np.argpartition(losses, n - 2)[: n - 1] if len(losses) >= n else np.arange(len(losses))
        # the one with the j-th least loss comes after j better texts, which leaves n - j places for its own list
        ranked = sorted((float(losses[k]), k) for k in chosen.tolist() if losses[k] < math.inf)
        lists = sorted((k, _led_by(tuple(ids[before[k] : before[k + 1]].tolist()), self.n_best(words[k], n - j))) for j, (_, k) in enumerate(ranked))
        place = {k: (int(before[k] - before[0]), int(before[k + 1] - before[k])) for k, _ in lists}
        return [(score - loss, [(*place[k], own) for k, own in changes]) for loss, changes in _combined(lists, n)[1:]]

    def decode(self, ids) -> str:
        """The text of ids; inverse of ``encode``."""
        return "".join([self.shown[i] for i in ids]).encode("utf-8", "surrogateescape").decode("utf-8", "replace")[1:]


def _flat(ids):
    out = []
    while ids:
        own, ids = ids
        out += own
    return tuple(out)


def _led_by(own, options):
    """The n best ``options`` of a segment with its chosen ids in front: of equal scores another one may stand there, or all of them."""
    return [(options[0][0], own), *[o for o in options if o[1] != own][: len(options) - 1]]


def _combined(lists, n):
    """The ``n`` best choices over independent segments: (loss, [(segment, ids)] for those not at their best).

    Backward A-star over the segments; what is before a segment can always be had without loss, which is the exact estimate.
    Ties are opened, and places closed, as in ``Segmenter.n_best``.
    """
    queue, count, out, opened = [(0.0, len(lists), 0, ())], 0, [], [0] * (len(lists) + 1)
    while queue and len(out) < n:
        loss, at, _, changes = heapq.heappop(queue)
        if at == 0:
            out.append((loss, list(changes)))
            continue
        if opened[at] == n:
            continue
        opened[at] += 1
        segment, options = lists[at - 1]
        for j, (score, ids) in enumerate(options):
            count += 1
            heapq.heappush(queue, (loss + options[0][0] - score, at - 1, count, ((segment, ids), *changes) if j else changes))
    return out


_SCHEMA = "ids array<int>, score double, alternatives array<struct<score double, changes array<struct<at int, tokens int, ids array<int>>>>>, restored boolean"


def encode_documents(docs: DataFrame, segmenter: Segmenter, n: int = BEST) -> DataFrame:
    """``doc_id, ids, score, alternatives, restored`` for each row of ``docs(doc_id, text)``.

    ``ids`` is the best segmentation, ``score`` its sum of piece scores; ``alternatives`` are the next best ones, up to ``n`` in all, as what
    they have instead of some tokens of the best. ``restored`` tells that decoding gave the text back. Null and empty texts have no ids.
    """
    changes = pa.list_(pa.struct([("at", pa.int32()), ("tokens", pa.int32()), ("ids", pa.list_(pa.int32()))]))
    alternatives = pa.list_(pa.struct([("score", pa.float64()), ("changes", changes)]))

    def run(batches):
        for batch in batches:
            _, offsets = byte_buffer(batch.column(1))
            for first, last in row_groups(offsets, SLICE_BYTES):
                texts = [t or "" for t in batch.column(1).slice(first, last - first).to_pylist()]
                ids, cuts, scores, found = segmenter.encode_many(texts, n)
                others = [[{"score": s, "changes": [{"at": a, "tokens": m, "ids": i} for a, m, i in c]} for s, c in f] for f in found]
                listed = ids.tolist()
                restored = [segmenter.decode(listed[a:b]) == t for a, b, t in zip(cuts[:-1], cuts[1:], texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids)), pa.array(scores, pa.float64()),
                     pa.array(others, alternatives), pa.array(restored)],
                    names=["doc_id", "ids", "score", "alternatives", "restored"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run, "pieces"), "doc_id long, " + _SCHEMA)
