"""Document fingerprints by winnowing.

Every ``k``-gram of bytes gets a rolling hash; of each window of ``w`` consecutive grams the smallest hash is
kept, the rightmost on ties, with its position. Any two texts that share a run of at least ``w + k - 1`` bytes
share a fingerprint of that run (the match guarantee), and nothing shorter than ``k`` bytes can match.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import argmin_right, byte_buffer, byte_codes, flat_ranges, gram_hashes, keyed_documents, mixed, partitions_for, row_groups, signed, text_bytes, text_pieces, tidy

GRAM, WINDOW = 20, 40
SEED = 11
#: Bytes of text that one task of the neighbour join holds at most, about.
TASK_BYTES = 24 << 20


def winnow(data: np.ndarray, offsets: np.ndarray, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of all rows of a byte buffer: row, hash, position.

    A text with fewer than ``w`` grams is one window; one with fewer than ``k`` bytes is one gram; an
    empty text has no fingerprint.
    """
    rows, hashes, positions = [], [], []
    codes = byte_codes(SEED)
    for first, last, here, inner, shift in text_pieces(data, offsets, w + k - 2):
        starts, ends = inner[:-1], inner[1:]
        lengths = ends - starts
        grams = np.maximum(lengths - k + 1, 0)
        h = mixed(gram_hashes(codes[here], k))
        # windows lie within one text; a shorter text has one window of all its grams
        wide = grams >= w
        if wide.any():
            best = argmin_right(h, w)
            at = flat_ranges(starts[wide], grams[wide] - w + 1)
            chosen, owner = best[at], np.repeat(np.flatnonzero(wide), grams[wide] - w + 1)
            new = np.ones(len(at), bool)
            new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
            rows.append(owner[new] + first)
            hashes.append(h[chosen[new]])
            positions.append(chosen[new] - starts[owner[new]] + shift)
        for i in np.flatnonzero(~wide & (lengths > 0)):
            a, n = starts[i], grams[i]
            if n:
                own = h[a : a + n]
                p = n - 1 - int(np.argmin(own[::-1]))
                value = own[p]
            else:
                p, value = 0, mixed(gram_hashes(codes[here[a : ends[i]]], int(lengths[i])))[0]
            rows.append(np.array([i + first]))
            hashes.append(np.array([value], np.uint64))
            positions.append(np.array([p]))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row, value, place = np.concatenate(rows), np.concatenate(hashes), np.concatenate(positions)
    order = np.lexsort((place, row))
    row, value, place = row[order], value[order], place[order]
    # pieces of a long text may choose the same place
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
    return row[new], value[new], place[new]


def _lists(data, offsets, k, w):
    """Per row: sorted distinct hashes, and (hashes, positions) in text order."""
    row, value, place = winnow(data, offsets, k, w)
    cuts = np.searchsorted(row, np.arange(len(offsets)))
    return [(np.unique(value[a:b]), value[a:b], place[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice coefficient of two sorted sets of hashes; two empty sets are equal (1), an empty and another are not (0)."""
    if not len(a) and not len(b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    return 2.0 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))


def fingerprint_text(hashes: np.ndarray, positions: np.ndarray) -> str:
    """``hash@position`` pairs in text order: the upper 32 bits of each hash in hexadecimal, byte positions in decimal."""
    return " ".join([f"{h:08x}@{p}" for h, p in zip((hashes >> np.uint64(32)).tolist(), positions.tolist())])


def fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """``doc_id, hashes array<long>, positions array<int>`` per row of ``docs(doc_id, text)``; empty and null texts have empty arrays."""

    def run(batches):
        for batch in batches:
            data, offsets = byte_buffer(batch.column(1))
            row, value, place = winnow(data, offsets, k, w)
            cuts = pa.array(np.searchsorted(row, np.arange(len(offsets))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(cuts, pa.array(signed(value))), pa.ListArray.from_arrays(cuts, pa.array(place, pa.int32()))],
                names=["doc_id", "hashes", "positions"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        tidy(run), "doc_id long, hashes array<long>, positions array<int>"
    )


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Documents dealt out by ranges of (doc_id, part), each range followed by the first document of the next one.

    Returns ``doc_id, part, text, range, guest``, each range in one partition and sorted. A guest row only lends its text
    to the last document of the range; the guest of the last range is the first document of all. The cut points are quantiles
    of the ids; the table of first documents that is broadcast has one row per range.
    """
    spark = docs.sparkSession
    keyed = keyed_documents(docs)
    count = partitions_for(text_bytes(keyed), TASK_BYTES, keyed)
    found = keyed.agg(F.percentile_approx("doc_id", [i / count for i in range(1, count)], 100 * count)).first()[0] if count > 1 else None
    cuts = np.array(sorted(set(found or [])), np.int64)

    @F.arrow_udf("int")
    def range_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, ids.to_numpy(zero_copy_only=False), "right").astype(np.int32))

    # null ids come before all others and so belong to the first range
    dealt = keyed.withColumn("range", range_of(F.coalesce(F.col("doc_id"), F.lit(-(2**63)))))
    firsts = dealt.groupBy("range").agg(F.min(F.struct("doc_id", "part")).alias("f")).orderBy("range").collect()
    hosts = [(firsts[i - 1]["range"], *r["f"]) for i, r in enumerate(firsts)]
    guests = F.broadcast(spark.createDataFrame(hosts, "host int, first_id long, first_part long"))
    joined = dealt.join(guests, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("part") == F.col("first_part")), "left")
    own = F.struct(F.col("range"), F.lit(False).alias("guest"))
    lent = F.struct(F.col("host").alias("range"), F.lit(True).alias("guest"))
    copies = F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, lent))
    return (
        joined.select("doc_id", "part", "text", F.explode(copies).alias("c"))
        .select("doc_id", "part", "text", "c.range", "c.guest")
        .repartitionById(len(cuts) + 1, "range")
        .sortWithinPartitions("guest", "doc_id", "part")
    )


def edited_fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Fingerprint every text and its edited text, whose last quarter comes from the next document by ascending id.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per row of
    ``docs(doc_id, text)``. The order is (doc_id, part), see ``keyed_documents``; null ids first; the first document follows
    the last. Null texts are empty. A document alone in the table is its own next one; exact repeats of a row follow
    each other.
    """

    def run(batches):
        held = None  # the last document seen, whose next one is still to come
        for batch in batches:
            ids, guest = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            data, offsets = byte_buffer(batch.column(2))
            for first, last in row_groups(offsets):
                texts = batch.column(2).slice(first, last - first).to_pylist()
                marks = _lists(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], k, w)
                out = []
                for i in range(first, last):
                    own = (ids[i], texts[i - first], marks[i - first])
                    if held is not None:
                        out.append((held, own))
                    held = None if guest[i] else own
                if out:
                    yield _compared(out, k, w)
        if held is not None:  # only where a range has no guest, that is, never
            raise RuntimeError("a range of documents has no successor")

    return with_neighbours(docs).select("doc_id", "part", "text", "guest").mapInArrow(
        tidy(run),
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def _compared(pairs, k, w) -> pa.RecordBatch:
    edited = []
    for (_, text, _), (_, following, _) in pairs:
        cut = len(text) // 4
        edited.append((text[: len(text) - cut] + following[:cut]).encode() if cut else text.encode())
    offsets = np.concatenate(([0], np.cumsum([len(e) for e in edited]))).astype(np.int64)
    marks = _lists(np.frombuffer(b"".join(edited), np.uint8), offsets, k, w)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([own[0] for own, _ in pairs], pa.int64()),
            pa.array([len(own[1]) for own, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
            pa.array([fingerprint_text(own[2][1], own[2][2]) for own, _ in pairs]),
            pa.array([fingerprint_text(m[1], m[2]) for m in marks]),
            pa.array([likeness(own[2][0], m[0]) for (own, _), m in zip(pairs, marks)], pa.float64()),
            pa.array([likeness(own[2][0], after[2][0]) for own, after in pairs], pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
