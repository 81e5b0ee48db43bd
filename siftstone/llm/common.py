"""Helpers shared by the training-data operators: inputs, stored tables, byte buffers, hashes."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_folder

#: Odd multiplier of the rolling hashes and the finaliser's constants (fixed values of the hash).
BASE = 0x9E3779B97F4A7C15
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB
#: Texts are handled in groups of about this many bytes, so that temporary arrays stay small.
GROUP_BYTES = 1 << 18


#: What an operator's tasks keep in their worker from one to the next, by operator.
KEPT: dict[str, dict] = {}


def release(keeps: str | None) -> None:
    """Drops what tasks of other operators have kept in this worker."""
    for operator, kept in KEPT.items():
        if operator != keeps and kept:
            kept.clear()
            gc.collect()
            _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the C library of Linux has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run, keeps: str | None = None):
    """A function for ``mapInArrow`` that hands memory back when its partition is done, as workers live on.

    ``keeps`` names the operator whose ``KEPT`` stays in the worker; that of others goes first, as workers run tasks of one stage after another.

    Meanwhile the collector of reference cycles rests, as it would walk through large stores again and again; what little there is goes at the end.
    """

    @functools.wraps(run)
    def wrapped(batches):
        release(keeps)
        collecting = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if collecting:
                gc.enable()
        gc.collect(0)
        _trim()

    return wrapped


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts the lineage, survives lost executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain_ids(docs: DataFrame) -> bool:
    """Whether every ``doc_id`` is there and names one row."""
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").isEmpty()


def keyed_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, part, text`` with a key that names one text.

    ``part`` is 0 where ids are unique and not null. Where an id is null or repeated, ``part`` is a
    64-bit hash of the text for all rows: different texts of one id are different documents, ordered by that hash,
    and exact repeats of a row are the same document. Null texts are empty.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    part = F.lit(0).cast("long") if plain_ids(ids) else F.xxhash64("text")
    return ids.select("doc_id", part.alias("part"), "text")


def partitions_for(amount: float, each: float, df: DataFrame) -> int:
    """Number of partitions so that each holds about ``each`` of ``amount``; at least the session's setting."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, int(amount / each) + 1)


def text_bytes(docs: DataFrame) -> int:
    """All bytes of the texts (one narrow scan)."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def join_spread(rows: DataFrame, lookup: DataFrame, on: list[str], weight: str) -> DataFrame:
    """``rows`` left-joined with ``lookup``, whose keys are unique and whose ``weight`` tells how many rows have that key (or more).

    Keys with a thousandth of all weight or more, so 1,000 at most, are broadcast; no task gets all rows of a frequent key.
    ``lookup`` loses ``weight``; both sides are read twice, so they should be stored.
    """
    total = lookup.agg(F.sum(weight)).first()[0] or 0
    frequent = F.coalesce(F.col(weight) * 1000 >= total, F.lit(False))
    heavy, light = lookup.filter(frequent).drop(weight), lookup.filter(~frequent).drop(weight)
    near = rows.join(F.broadcast(heavy), on)
    far = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light.hint("merge"), on, "left")
    return near.unionByName(far)


def byte_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column without a copy, and the offsets of its rows. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def row_groups(offsets: np.ndarray, most: int = GROUP_BYTES):
    """Ranges of whole rows with about ``most`` bytes each; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def text_pieces(data: np.ndarray, offsets: np.ndarray, overlap: int, most: int = GROUP_BYTES):
    """Groups of whole rows and pieces of long ones: (first row, last row, bytes, offsets within, shift of the piece in its row).

    Neighbouring pieces of a row share ``overlap`` bytes, so that every span of ``overlap + 1`` bytes lies in exactly one that starts there.
    """
    for first, last in row_groups(offsets, most):
        a, b = int(offsets[first]), int(offsets[last])
        if b - a <= 4 * most:
            yield first, last, data[a:b], offsets[first : last + 1] - a, 0
            continue
        for p in range(a, b, most):
            end = min(p + most + overlap, b)
            yield first, last, data[p:end], np.array([0, end - p]), p - a
            if end == b:
                break


def word_pieces(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, most: int = 4 * GROUP_BYTES):
    """Cuts that no word crosses: (start, end, offsets within), pieces of about ``most`` bytes."""
    at = 0
    while at < len(data) or at == 0:
        end = min(at + most, len(data))
        while end < len(data):
            gaps = np.flatnonzero(separator[data[end : end + most]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + most, len(data))
        inner = offsets[(offsets > at) & (offsets < end)]
        yield at, end, np.concatenate(([at], inner, [end])) - at
        at = end
        if at == len(data):
            break


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_A)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_B)
    return h ^ (h >> np.uint64(31))


def byte_codes(seed: int = 1) -> np.ndarray:
    """A fixed random odd 64-bit number per byte value."""
    return np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)


def power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every k-gram (length - k + 1 of them): doubles the gram, then joins two that overlap nowhere."""
    if len(codes) < k:
        return np.zeros(0, np.uint64)
    done, h, n = None, codes, 1
    left, size = k, 0
    while left:
        if left & 1:
            done = h if done is None else h[: len(h) - size] * power(size) + done[n:]
            size += n
        left >>= 1
        if left:
            h = h[: len(h) - n] * power(n) + h[n:]
            n *= 2
    return done[: len(codes) - k + 1]


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` entries."""
    n, m = 1, h
    while n * 2 <= w:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    count = len(h) - w + 1
    return np.minimum(m[:count], m[w - n : w - n + count])


def argmin_right(h: np.ndarray, w: int) -> np.ndarray:
    """Index of the smallest entry of each window of ``w``, the rightmost on ties (windows double, then two overlap)."""
    at = np.arange(len(h), dtype=np.int64)
    n, count = 1, len(h) - w + 1

    def better(left, right):
        return np.where(h[right] <= h[left], right, left)

    while n * 2 <= w:
        at = better(at[:-n], at[n:])
        n *= 2
    return better(at[:count], at[w - n : w - n + count])


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start, start + 1, …`` for every (start, length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for n places at least."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * GROUP_BYTES)
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS


def prefix_hashes(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Running polynomial hashes, from which ``span_hashes`` gets that of any span."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * _powers(len(data))[0][: len(data)], out=total[1:])
    return total


def span_hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans from ``start`` to ``end``, the same wherever the bytes stand."""
    return (total[end] - total[start]) * _powers(len(total))[1][start]


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, codes: np.ndarray):
    """Words of all rows: row, start, end, 64-bit hash. ``separator[b]`` tells the bytes between words; no word crosses rows."""
    parts = []
    for a, b, inner in word_pieces(data, offsets, separator):
        start, end, h = _words(data[a:b], inner, separator, codes)
        parts.append((start + a, end + a, h))
    start, end, h = (np.concatenate(c) for c in zip(*parts))
    return np.searchsorted(offsets, start, "right") - 1, start, end, h


def _words(data, offsets, separator, codes):
    inside = ~separator[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[:1], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1:], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    h = mixed(span_hashes(prefix_hashes(data, codes), start, end))
    return start, end, h
