"""Removal of byte strings that occur earlier in the corpus, by sorting suffixes.

The string of ``length`` bytes at every byte of every document is a suffix, cut to the length that matters. Equal strings have the
same anchor, the smallest hash among their ``GRAM``-byte grams. So neighbouring suffixes with the same anchor travel as one row,
whose leading tokens are the anchor and the hash of all bytes that its suffixes cover. Splitters sampled from the rows
range-partition them by these tokens; each bucket is sorted by itself, a later token only where earlier ones tie. A row equal in both tokens to an
earlier one repeats it as a whole. The first of several rows with the same anchor but other bytes around it, and whatever touches the
boundary of a bucket, travels again with its bytes; these rows are range-partitioned by anchor and taken apart into suffixes, which are sorted
bucket by bucket. An anchor whose rows lie in several buckets has the first of its equal suffixes in each compared across the boundaries. Hot strings
need no care: position is the last token, so a bucket ends inside them where it must.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    byte_buffer, byte_codes, flat_ranges, gram_hashes, keyed_documents, mixed, partitions_for, prefix_hashes, row_groups, signed, sliding_min, span_hashes, stored,
    text_bytes, text_pieces, tidy,
)

LENGTH = 100
GRAM = 32
#: Rows of one bucket, about: what a task holds in memory.
BUCKET_ROWS = 400_000
#: A null id stands before all others.
NO_ID = -(2**63)

_ROWS = "gram long, covered long, doc long, part long, start long, suffixes long"


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows by several columns; each further column is looked at only where all earlier ones tie."""
    order = np.argsort(columns[0], kind="stable")
    tied = np.arange(len(order))  # places in the order that still share their keys with a neighbour
    same = np.zeros(max(len(order), 1), bool)
    same[1:] = columns[0][order][1:] == columns[0][order][:-1]
    for column in columns[1:]:
        joined = same.copy()
        joined[:-1] |= same[1:]
        tied = np.flatnonzero(joined)
        if not len(tied):
            break
        group = np.cumsum(~same)[tied]
        rows = order[tied]
        inner = np.lexsort((column[rows], group))
        order[tied] = rows[inner]
        value = column[order]
        same[1:] &= value[1:] == value[:-1]
    return order


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before; the first always does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _whole(batches):
    """All rows of a bucket as numpy columns."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    return [np.concatenate(c) for c in zip(*parts)] if parts else None


def anchored_rows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """A row per anchor of ``docs(doc, part, text)``: its hash, that of all covered bytes, and where its suffixes start."""

    def run(batches):
        codes, other = byte_codes(23), byte_codes(29)
        window = length - GRAM + 1
        for batch in batches:
            data, offsets = byte_buffer(batch.column(2))
            doc, part = (batch.column(i).to_numpy() for i in (0, 1))
            for first, last, here, inner, shift in text_pieces(data, offsets, length - 1):
                starts, ends = inner[:-1], inner[1:]
                count = np.maximum(ends - starts - length + 1, 0)
                if not count.any():
                    continue
                grams = mixed(gram_hashes(codes[here], GRAM))
                least = sliding_min(grams, window)
                at = flat_ranges(starts, count)
                owner, anchor = np.repeat(np.arange(last - first), count), least[at]
                new = _changes(anchor, owner)
                # where a suffix starts with its anchor and the next one has the same, the anchor comes again 1 to ``window`` bytes on
                # and equal suffixes may follow each other: each is a row then
                first_gram = np.flatnonzero((grams[at] == anchor) & ~np.append(new[1:], True))
                run = np.cumsum(new) - 1
                new |= np.isin(run, run[first_gram])
                new = np.flatnonzero(new)
                suffixes = np.diff(np.append(new, len(at)))
                start, row = at[new], owner[new]
                covered = mixed(span_hashes(prefix_hashes(here, other), start, start + suffixes + length - 1) + mixed(suffixes.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(anchor[new])), pa.array(signed(covered)), pa.array(doc[first:last][row]), pa.array(part[first:last][row]),
                     pa.array(start - starts[row] + shift), pa.array(suffixes)],
                    names=["gram", "covered", "doc", "part", "start", "suffixes"],
                )

    return docs.select("doc", "part", "text").mapInArrow(tidy(run), _ROWS)


def sorted_anchors(rows: DataFrame, buckets: int) -> DataFrame:
    """``gram, doc, part, start, suffixes, repeats``: rows that repeat an earlier one, and those to be taken apart; unique ones are gone."""

    def run(batches):
        columns = _whole(batches)
        if columns is None:
            return
        order = multikey_order(columns)
        gram, covered, doc, part, start, suffixes = (c[order] for c in columns)
        run_start = _changes(gram, covered)
        first = np.flatnonzero(run_start)[np.cumsum(run_start) - 1]
        # an equal position is a repeated row of the same document, not an earlier occurrence
        repeats = (doc != doc[first]) | (part != part[first]) | (start != start[first])
        group = np.cumsum(_changes(gram)) - 1
        several = np.bincount(group, weights=run_start)[group] > 1
        edge = (group == 0) | (group == group[-1])
        keep = np.flatnonzero(repeats | several | edge)
        for a in range(0, len(keep), 50_000):
            k = keep[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(c[k]) for c in (gram, doc, part, start, suffixes, repeats)], names=["gram", "doc", "part", "start", "suffixes", "repeats"])

    dealt = rows.repartitionByRange(buckets, "gram", "covered", "doc", "part", "start")
    return dealt.mapInArrow(tidy(run), "gram long, doc long, part long, start long, suffixes long, repeats boolean")


def with_bytes(texts: DataFrame, apart: DataFrame, length: int = LENGTH) -> DataFrame:
    """``gram, doc, part, start, bytes`` for each row that is to be taken apart: all bytes that its suffixes cover."""
    wanted = apart.groupBy("doc", "part").agg(F.collect_list(F.struct("gram", "start", "suffixes")).alias("runs"))

    def run(batches):
        for batch in batches:
            data, offsets = byte_buffer(batch.column(2))
            doc, part, runs = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3))
            flat = runs.flatten()
            gram, start, number = (flat.field(i).to_numpy() for i in range(3))
            row = np.repeat(np.arange(batch.num_rows), np.diff(runs.offsets.to_numpy()))
            size = number + length - 1
            for a in range(0, len(row), 5_000):
                k = slice(a, a + 5_000)
                taken = data[flat_ranges(offsets[row[k]] + start[k], size[k])]
                cuts = pa.py_buffer(np.concatenate(([0], np.cumsum(size[k]))).astype(np.int32))
                held = pa.Array.from_buffers(pa.binary(), len(size[k]), [None, cuts, pa.py_buffer(taken.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(gram[k]), pa.array(doc[row[k]]), pa.array(part[row[k]]), pa.array(start[k]), held], names=["gram", "doc", "part", "start", "bytes"])

    return texts.join(wanted, ["doc", "part"]).select("doc", "part", "text", "runs").mapInArrow(tidy(run), "gram long, doc long, part long, start long, bytes binary")


def taken_apart(rows: DataFrame, buckets: int, length: int = LENGTH) -> DataFrame:
    """``one, two, doc, part, start, sure``: suffixes equal to an earlier one in their bucket (sure), and those that are the first of
    their bucket while their anchor goes on beyond it. The two hashes name the bytes of a suffix."""

    def run(batches):
        tables, parts = (byte_codes(31), byte_codes(37)), []
        for batch in batches:
            data, offsets = byte_buffer(batch.column(4))
            gram, doc, part, start = (batch.column(i).to_numpy() for i in range(4))
            for first, last in row_groups(offsets):
                base = offsets[first]
                own = np.arange(first, last)
                count = np.diff(offsets[first : last + 1]) - length + 1
                at, row = flat_ranges(offsets[first:last] - base, count), np.repeat(own, count)
                hashes = [span_hashes(prefix_hashes(data[base : offsets[last]], t), at, at + length) for t in tables]
                parts.append([*(signed(h) for h in hashes), doc[row], part[row], start[row] + at - offsets[row] + base, gram[row]])
        if not parts:
            return
        columns = [np.concatenate(c) for c in zip(*parts)]
        order = multikey_order(columns[:5])
        one, two, doc, part, start, gram = columns = [c[order] for c in columns]
        run_start = _changes(one, two)
        first = np.flatnonzero(run_start)[np.cumsum(run_start) - 1]
        sure = (doc != doc[first]) | (part != part[first]) | (start != start[first])
        edge = run_start & ((gram == gram.min()) | (gram == gram.max()))
        keep = np.flatnonzero(sure | edge)
        for a in range(0, len(keep), 50_000):
            k = keep[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(c[k]) for c in (*columns[:5], sure)], names=["one", "two", "doc", "part", "start", "sure"])

    dealt = rows.repartitionByRange(buckets, "gram", "doc", "part", "start")
    return dealt.mapInArrow(tidy(run), "one long, two long, doc long, part long, start long, sure boolean")


def across_boundaries(firsts: DataFrame) -> DataFrame:
    """``doc, part, start`` of the suffixes of ``firsts`` that have an equal one at an earlier position.

    One row per bucket and distinct suffix of an anchor on its boundary: equal ones are aggregated before they are dealt out.
    """
    place = F.struct("doc", "part", "start")
    earliest = firsts.groupBy("one", "two").agg(F.min(place).alias("earliest"), F.max(place).alias("latest")).filter("latest > earliest")
    return firsts.join(earliest, ["one", "two"]).filter(place > F.col("earliest")).select("doc", "part", "start")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept binary`` for each row of ``docs(doc_id, text)``.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a smaller document (by id, null ids first) or
    earlier in the same one. Strings are judged on the input. Null texts are empty; texts shorter than ``length`` stay. Exact
    repeats of a row are one document, whose rows get the same result; different texts of one id are ordered by a hash.
    Strings count as equal if 128 bits of hashes are.
    """
    keyed = keyed_documents(docs)
    # the same columns in both joins, so that the texts are shuffled once
    texts = keyed.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "part", "text")
    # about two anchors per (length - GRAM + 2) bytes
    anchors = 2 * text_bytes(texts) / (length - GRAM + 2)
    found = stored(sorted_anchors(anchored_rows(texts, length), partitions_for(anchors, BUCKET_ROWS, docs)), "repeated-anchors")
    apart = found.filter("NOT repeats").drop("repeats")
    number = apart.agg(F.sum("suffixes")).first()[0] or 0
    late = taken_apart(with_bytes(texts, apart, length), partitions_for(number, BUCKET_ROWS, docs), length)
    single = late.filter("sure").select("doc", "part", "start").unionByName(across_boundaries(late.filter("NOT sure")))
    spans = found.filter("repeats").select("doc", "part", "start", (F.col("suffixes") + length - 1).alias("bytes")).unionByName(
        single.withColumn("bytes", F.lit(length).cast("long"))
    )
    listed = spans.groupBy("doc", "part").agg(F.collect_list(F.struct("start", "bytes")).alias("spans"))
    joined = texts.join(listed, ["doc", "part"], "left").select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "text", "spans")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                out = [_kept(t.as_buffer(), s) for t, s in zip(piece.column(1), piece.column(2))]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0)] + [pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return joined.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _kept(text, spans):
    """Length, removed bytes, removed runs and what is left of one text."""
    data = memoryview(text) if text is not None else memoryview(b"")
    if not spans.is_valid or not len(spans):
        return len(data), 0, 0, bytes(data)
    start, size = (spans.values.field(i).to_numpy() for i in (0, 1))
    step = np.zeros(len(data) + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + size, -1)
    gone = np.cumsum(step[:-1]) > 0
    runs = int(np.count_nonzero(gone & ~np.concatenate(([False], gone[:-1]))))
    return len(data), int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()
