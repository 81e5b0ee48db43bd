"""Phrase collocations from sorted count streams.

Phrases of each length are counted by themselves, shorter ones first: a phrase can only be frequent if its first and its last words
without one are, so those are looked up in a bitmap before anything is counted or sent. The frequent ones are then laid out as two
streams. In prefix order (by the first word, the second, …) a phrase follows its own beginnings and is followed by its
continuations; in suffix order (by the last word, the one before, …) the same holds for its ends. One pass in lockstep over each stream,
with no more than the beginnings of the current phrase at hand, yields the counts of all left parts, all right parts and of
the most frequent longer phrase on either side; the two results are merged phrase by phrase.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_buffer, byte_codes, flat_ranges, join_spread, mixed, partitions_for, row_groups, signed, stored, tidy, word_pieces, words

LONGEST, LEAST, FIRST = 3, 10, 2_000
#: A candidate gives way to a longer one with at least this share (in hundredths) of its count.
COVERED = 50
#: What a score of 1 is multiplied by before it is rounded down.
SCALE = 1_000_000
#: Words gathered before their phrases are counted and handed on.
FLUSH_WORDS = 1 << 22
#: The bitmap has about 8 bits per frequent phrase, and 2 ** MOST_BITS at most (32 MB); beyond that it just keeps out less.
LEAST_BITS, MOST_BITS = 20, 28
#: Phrases per range of a stream, about.
RANGE_ROWS = 500_000

_BREAK, _SEPARATOR = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SEPARATOR[:] = _BREAK
_SEPARATOR[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_CODES = byte_codes(47)
_CODES[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]


def _lang_code(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def word_groups(batch):
    """Words of a batch of (lang, text) in groups: id (lang and word), whether it opens a piece, row, start, end, and the bytes they lie in."""
    langs = batch.column(0).to_pylist()
    code = {lang: _lang_code(lang) for lang in set(langs)}
    codes = np.array([code[lang] for lang in langs], np.uint64)
    data, offsets = byte_buffer(batch.column(1))
    for first, last in row_groups(offsets):
        here, inner = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        cuts = [(0, len(here), inner)] if last > first + 1 else word_pieces(here, inner, _SEPARATOR)  # a long text comes in parts
        broken = True
        for a, b, part in cuts:
            piece = here[a:b]
            row, start, end, h = words(piece, part, _SEPARATOR, _CODES)
            breaks = np.concatenate(([0], np.cumsum(_BREAK[piece])))
            opens = np.empty(len(row), bool)
            if len(row):
                opens[1:] = (breaks[start[1:]] > breaks[end[:-1]]) | (row[1:] != row[:-1])
                opens[0] = broken or breaks[start[0]] > 0
                broken = breaks[-1] > breaks[end[-1]]
            else:
                broken = broken or bool(breaks[-1])
            yield mixed(h + codes[first + row]), opens, first + row, start, end, piece


def _groups_of(sorted_columns: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(sorted_columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(sorted_columns[0]), bool)
    new[0] = True
    for column in sorted_columns:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, id, n`` of all words; ``id`` is a 64-bit hash of lang and word."""

    def counted(parts):
        ids, n, langs, lengths = (np.concatenate(c) for c in zip(*[p[:4] for p in parts]))
        spelled = np.concatenate([p[4] for p in parts])
        order = np.argsort(ids, kind="stable")
        begins = _groups_of([ids[order]])
        pick, starts = order[begins], np.concatenate(([0], np.cumsum(lengths)[:-1]))
        return ids[pick], np.add.reduceat(n[order], begins), langs[pick], lengths[pick], spelled[flat_ranges(starts[pick], lengths[pick])]

    def batch_of(part, names):
        ids, n, langs, lengths, spelled = part
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        word = pa.StringArray.from_buffers(len(ids), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(spelled)))
        return pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(langs)), word, pa.array(signed(ids)), pa.array(n)], names=["lang", "word", "id", "n"])

    def run(batches):
        parts, held, names, places = [], 0, [], {}
        for batch in batches:
            own = batch.column(0).to_pylist()
            for lang in dict.fromkeys(own):
                if places.setdefault(lang, len(names)) == len(names):
                    names.append(lang)
            at = np.array([places[lang] for lang in own], np.int32)
            for ids, _, row, start, end, piece in word_groups(batch):
                if len(ids):
                    order = np.argsort(ids, kind="stable")
                    begins = _groups_of([ids[order]])
                    pick, lengths = order[begins], (end - start)[order[begins]]
                    n = np.diff(np.append(begins, len(ids)))
                    parts.append((ids[pick], n, at[row[pick]], lengths, _LOWER[piece[flat_ranges(start[pick], lengths)]]))
                    held += len(pick)
                if held >= FLUSH_WORDS // 4:
                    yield batch_of(counted(parts), names)
                    parts, held = [], 0
        if parts:
            yield batch_of(counted(parts), names)

    per_task = docs.mapInArrow(tidy(run), "lang string, word string, id long, n long")
    return per_task.groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def _bit_column(names: list[str], bits: int) -> Column:
    """The bit of a phrase, from the ids of its words."""
    out = F.lit(0).cast("long")
    for i, name in enumerate(names):
        out = out.bitwiseXOR(F.shiftrightunsigned(name, 5 * i).bitwiseAND(F.lit((1 << bits) - 1)))
    return out


def _bits_of(ids: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros(len(ids[0]), np.uint64)
    for i, column in enumerate(ids):
        out ^= (column >> np.uint64(5 * i)) & np.uint64((1 << bits) - 1)
    return out.astype(np.int64)


def bitmap(phrases: DataFrame, names: list[str]) -> tuple[int, np.ndarray]:
    """Number of bits (as a power of 2) and a bitmap in which every phrase of the table has its bit set."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(8 * phrases.count() + 1))))
    bit = _bit_column(names, bits)
    pages = phrases.groupBy(F.shiftright(bit, 15).alias("page")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros((1 << bits) >> 3, np.uint8)
    for page, data in pages.collect():  # 2 ** (MOST_BITS - 15) pages of 4 KB at most
        out[page << 12 : (page + 1) << 12] = np.frombuffer(bytes(data), np.uint8)
    return bits, out


def phrase_counts(docs: DataFrame, shorter: DataFrame, length: int, least: int) -> DataFrame:
    """``w0, w1, …, n`` of the phrases of ``length`` words found ``least`` times or more; ``shorter`` has all frequent phrases of a word less."""
    known = docs.sparkSession.sparkContext.broadcast(bitmap(shorter, [f"w{i}" for i in range(length - 1)]))

    def counted(ids, opens):
        bits, table = known.value
        n = max(0, len(ids) - length + 1)
        joined = np.ones(n, bool)
        for i in range(1, length):
            joined &= ~opens[i : n + i]
        bit = _bits_of([ids[i : n + 1 + i] for i in range(length - 1)], bits)  # of every phrase of a word less
        frequent = (table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
        at = np.flatnonzero(joined & frequent[:n] & frequent[1 : n + 1])
        key = np.zeros(len(at), np.uint64)
        for i in range(length):
            key = mixed(key + ids[at + i])
        at = at[np.argsort(key)]
        columns = [ids[at + i] for i in range(length)]
        begins = _groups_of(columns)  # by the words themselves; equal keys of different phrases only split a count
        counts = np.diff(np.append(begins, len(at)))
        return pa.RecordBatch.from_arrays([*[pa.array(signed(c[begins])) for c in columns], pa.array(counts)], names=[*names, "n"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for ids, opens, *_ in word_groups(batch):
                parts.append((ids, opens))
                held += len(ids)
                if held >= FLUSH_WORDS:
                    ids, opens = (np.concatenate(c) for c in zip(*parts))
                    yield counted(ids, opens)
                    parts, held = [(ids[1 - length :], opens[1 - length :])], length - 1  # a text may go on; shorter than a phrase, so nothing counts twice
        if parts:
            yield counted(*(np.concatenate(c) for c in zip(*parts)))

    names = [f"w{i}" for i in range(length)]
    per_task = docs.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in [*names, "n"]))
    return per_task.groupBy(*names).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# ── the two streams ─────────────────────────────────────────────────────────


def _key(names: list[str]) -> Column:
    """The words' ids as bytes, so that binary order is the order of the words and a beginning sorts before what it begins."""
    return F.concat(*[F.unhex(F.lpad(F.hex(n), 16, "0")) for n in names])


def lockstep(stream: DataFrame, longest: int) -> DataFrame:
    """``key, n, parts, longer`` for every row of ``stream(place, key, n)``: counts of all shorter beginnings of ``place`` (shortest first), and
    the largest count of a phrase that goes on by a word (0: none).

    ``place`` sorts. Ranges are cut at sampled places; a phrase whose continuations lie in several ranges is handed to each of them, which adds
    ``longest - 1`` rows a range at most, and its ``longer`` is the largest of theirs.
    """
    rows = stream.count()
    ranges = rows // RANGE_ROWS + 1
    sample = stream.sample(min(1.0, 20 * ranges / max(rows, 1)), 5).select("place").collect() if ranges > 1 else []  # about 20 places a range
    cuts = sorted(bytes(r.place) for r in sample)[10::20]

    def deal(batches):
        for batch in batches:
            span, own, pick = [], [], []
            for i, place in enumerate(batch.column(0).to_pylist()):
                first, last = bisect_right(cuts, place), bisect_right(cuts, place.ljust(8 * longest, b"\xff"))
                span += range(first, last + 1)
                own += [k == first for k in range(first, last + 1)]
                pick += [i] * (last - first + 1)
            rows = batch.take(pa.array(pick, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(span, pa.int32()), pa.array(own, pa.bool_()), *rows.columns], names=["span", "own", *rows.schema.names])

    def merge(batches):
        opened, inside = [], None  # the phrases that the current one begins with: place, row to hand on, largest continuation
        for batch in batches:
            done = []
            for span, own, place, key, n in zip(*(c.to_pylist() for c in batch.columns)):
                while opened and (span != inside or not place.startswith(opened[-1][0])):
                    done.append(opened.pop())
                inside = span
                if opened:
                    opened[-1][2] = max(opened[-1][2], n)
                opened.append([place, (own, key, n, [o[1][2] for o in opened]), 0])
            yield _merged(done)
        yield _merged(opened)

    dealt = stream.select("place", "key", "n").mapInArrow(tidy(deal), "span int, own boolean, place binary, key binary, n long")
    dealt = dealt.repartition(partitions_for(rows, RANGE_ROWS, stream), "span").sortWithinPartitions("span", "place")
    found = stored(dealt.mapInArrow(tidy(merge), "own boolean, key binary, n long, parts array<long>, longer long"), "phrases-merged")
    more = found.filter("NOT own").groupBy("key").agg(F.max("longer").alias("more"))  # at most longest - 1 rows a range
    return found.filter("own").join(F.broadcast(more), "key", "left").select("key", "n", "parts", F.greatest("longer", "more").alias("longer"))


def _merged(done):
    own, key, n, parts = zip(*[row for _, row, _ in done]) if done else ((), (), (), ())
    columns = [(own, pa.bool_()), (key, pa.binary()), (n, pa.int64()), (parts, pa.list_(pa.int64())), ([longer for _, _, longer in done], pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["own", "key", "n", "parts", "longer"])


def _scores(batches):
    """Score of every candidate at its lowest-scoring cut; Python's integers hold the products."""
    for batch in batches:
        rows = []
        for key, a, left, right in zip(*(c.to_pylist() for c in batch.columns)):
            length = len(key) // 8
            # cut after k words: the first k are left[k - 1], the rest are the last length - k
            score, k = min((SCALE * a * a // (left[k - 1] * right[length - k - 1]), k) for k in range(1, length))
            rows.append((key, a, left[k - 1], right[length - k - 1], score))
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.binary()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["key", "a", "l", "r", "score"]
        )


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, first: int = FIRST, covered: int = COVERED) -> DataFrame:
    """Each lang's ``first`` best phrases of 2 to ``longest`` words: ``lang, rank, phrase, a, l, r, n, score``.

    ``docs`` has ``lang`` (null: ``und``) and ``text`` (null: empty). A phrase lies within a piece of text between two of ``.,;:!?`` and line breaks, and
    counts wherever it stands, overlaps included: ``a`` times, ``least`` at least. ``l`` and ``r`` count the parts before and after its weakest cut, ``n`` all words
    of the lang; ``score`` is ``a * a / (l * r)`` in millionths. A phrase inside a longer candidate that has ``covered`` hundredths of its count is left out.
    Ties go to the larger ``a``, then to the smaller phrase in byte order. Repeated rows count each time; texts without words add nothing; without candidates there are no rows.
    Equality of words is decided on 64-bit hashes.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    known = stored(word_counts(docs), "phrases-words")
    frequent = known.filter(F.col("n") >= least)
    levels = [frequent.select(F.col("id").alias("w0"), "n")]
    for length in range(2, longest + 1):
        levels.append(stored(phrase_counts(docs, levels[-1], length, least), f"phrases-{length}"))
    names = [[f"w{i}" for i in range(length)] for length in range(1, longest + 1)]
    layout = [level.select(_key(w).alias("key"), _key(w[::-1]).alias("end"), "n") for level, w in zip(levels, names)]
    both = layout[0]
    for other in layout[1:]:
        both = both.unionByName(other)
    both = stored(both, "phrases-streams")
    left = lockstep(both.select(F.col("key").alias("place"), "key", "n"), longest)
    right = lockstep(both.select(F.col("end").alias("place"), "key", "n"), longest)
    candidates = (
        left.filter(F.length("key") > 8).join(right.select("key", F.col("parts").alias("rest"), F.col("longer").alias("before")).hint("merge"), "key")
        .filter(F.greatest("longer", "before") * 100 < F.col("n") * covered).select("key", "n", "parts", "rest")
    )
    scored = stored(candidates.mapInArrow(tidy(_scores), "key binary, a long, l long, r long, score long"), "phrases-scored")
    spelled = scored.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("key") / 8 - 1).cast("int")), lambda i: F.substring("key", i * 8 + 1, F.lit(8)))).alias("at", "id"))
    spelled = stored(spelled, "phrases-places")
    vocabulary = frequent.select(_key(["id"]).alias("id"), "lang", "word").join(spelled.groupBy("id").agg(F.count(F.lit(1)).alias("uses")), "id")
    texts = join_spread(spelled, stored(vocabulary, "phrases-vocabulary"), ["id"], "uses").groupBy("key").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase")
    )
    # every task keeps no more than ``first`` rows of a lang before they meet (WindowGroupLimit)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = scored.join(texts, "key").withColumn("rank", place).filter(F.col("rank") <= first)
    totals = known.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
