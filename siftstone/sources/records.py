"""CSV records cut in parallel, wherever quoted line breaks stand.

A block of a file cannot tell whether it begins inside quotes. So each block is read as a small automaton first: for every state in which it might
begin (outside quotes, inside, just behind a quote that closes or escapes), the state in which it ends. Composed in file order these give the state
at every block's start, and with it each block cuts its own records; one that runs over the block's end is read on. One large file is many tasks.
"""

from __future__ import annotations

import csv
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranges

#: States between two bytes: outside quotes; inside; inside, behind a quote that ends the value or escapes the next quote.
OUT, IN, BEHIND = 0, 1, 2
STATES = (OUT, IN, BEHIND)
#: Bytes looked at together, so that a stray quote costs no more than that.
_WINDOW = 1 << 14
_QUOTE, _LINE, _RETURN = 0x22, 0x0A, 0x0D


def inside_quotes(data: np.ndarray, state: int, before: int, separator: int) -> tuple[np.ndarray, int]:
    """For every byte whether it lies inside quotes (a value's own quotes count as either), and the state behind the last.

    ``before`` is the byte in front of ``data`` (a line break at a file's start). Where each quote that opens stands at the start of a value or behind a quote,
    all of it is a parity of quotes. A quote amid a plain value breaks that; it and the rest of its value are passed over.
    """
    inside = np.empty(len(data), bool)
    at = 0
    while at < len(data):
        part = data[at : at + _WINDOW]
        quotes = np.flatnonzero(part == _QUOTE)
        opened = 1 if state == IN else 0
        previous = np.where(quotes > 0, part[quotes - 1], before)
        opens = (np.arange(len(quotes)) + opened) % 2 == 0
        fits = (previous == separator) | (previous == _LINE) | (previous == _RETURN) | (previous == _QUOTE)
        if len(quotes) and quotes[0] == 0 and before == _QUOTE:
            fits[0] = state != OUT  # outside, the quote before is a character of a plain value
        wrong = np.flatnonzero(opens & ~fits)
        good = int(quotes[wrong[0]]) if len(wrong) else len(part)
        flips = np.zeros(good + 1, np.int8)
        flips[quotes[quotes < good] + 1] = 1
        parity = (np.cumsum(flips) + opened) % 2
        inside[at : at + good] = parity[:good] == 1
        if good:
            state = IN if parity[good] else BEHIND if part[good - 1] == _QUOTE else OUT
            before = int(part[good - 1])
        at += good
        if len(wrong):  # a quote amid a plain value is a character, and so are all up to the value's end
            rest = data[at + 1 : at + 1 + _WINDOW]
            ends = np.flatnonzero((rest == separator) | (rest == _LINE) | (rest == _RETURN))
            step = int(ends[0]) + 2 if len(ends) else len(rest) + 1
            inside[at : at + step] = False
            at += step
            state, before = OUT, int(data[min(at, len(data)) - 1])
    return inside, state


def _facts(data: bytes, lead: int, size: int, separator: int):
    """Per state at the start: the state at the end, and whether a line break lies inside quotes."""
    block = np.frombuffer(data, np.uint8)[lead : lead + size]
    before = data[lead - 1] if lead else _LINE
    if b'"' not in data[lead : lead + size]:
        broken = bool((block == _LINE).any() or (block == _RETURN).any())
        return [OUT, IN, OUT], [False, broken, False]
    ends, broken = [], []
    for state in STATES:
        inside, end = inside_quotes(block, state, before, separator)
        ends.append(end)
        broken.append(bool((((block == _LINE) | (block == _RETURN)) & inside).any()))
    return ends, broken


def block_states(files: DataFrame, root: str, separator: str = ",", size: int | None = None) -> DataFrame:
    """``path, length, start, state, quoted_break, utf8, returns`` of every block: the state at its start, whether a line break lies inside quotes
    in it, whether it is UTF-8, and whether it has a carriage return that no line feed follows."""
    size, mark = size or ranges.BLOCK_BYTES, ord(separator)

    def read(batches):
        store, _, prefix = ranges.open_store(root)
        for batch in batches:
            rows = []
            for path, length, start in zip(*(c.to_pylist() for c in batch.columns)):
                data, lead = ranges.read_block(store, path[len(prefix) :], start, size, 1, 4)
                own = data[lead:]
                more = max(0, len(own) - size)
                utf8 = ranges.is_utf8(own, start == 0, start + len(own) >= length, more)
                lone = own.count(b"\r", 0, size) > own.count(b"\r\n", 0, size + 1)
                rows.append((path, length, start, *_facts(data, lead, size, mark), utf8, lone))
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["path", "length", "start", "ends", "broken", "utf8", "returns"])

    def compose(batches):
        state = OUT
        for batch in batches:
            rows = []
            for path, length, start, ends, broken, utf8, lone in zip(*(c.to_pylist() for c in batch.columns)):
                if start == 0:
                    state = OUT
                rows.append((path, length, start, state, broken[state], utf8, lone))
                state = ends[state]
            columns = list(zip(*rows)) or [()] * 7
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_())
            names = ["path", "length", "start", "state", "quoted_break", "utf8", "returns"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    found = ranges.blocks(files, size).mapInArrow(
        read, "path string, length long, start long, ends array<int>, broken array<boolean>, utf8 boolean, returns boolean"
    )
    # a few dozen bytes a block go through the file's one task
    ordered = found.repartition("path").sortWithinPartitions("path", "start")
    return ordered.mapInArrow(compose, "path string, length long, start long, state int, quoted_break boolean, utf8 boolean, returns boolean")


def file_layouts(states: DataFrame) -> DataFrame:
    """``path, utf8, quoted_break, returns``: a file's facts, from all its blocks."""
    return states.groupBy("path").agg(F.bool_and("utf8").alias("utf8"), F.bool_or("quoted_break").alias("quoted_break"), F.bool_or("returns").alias("returns"))


def cut_records(states: DataFrame, root: str, separator: str = ",", size: int | None = None) -> DataFrame:
    """``path, first, record`` of ``states`` (with ``encoding`` of each file): every record as text without its line break.

    ``first`` marks a file's first record. Records without any character are left out, as by Spark's reader.
    """
    size, mark = size or ranges.BLOCK_BYTES, ord(separator)

    def run(batches):
        store, _, prefix = ranges.open_store(root)
        for batch in batches:
            for path, _, start, state, encoding in zip(*(c.to_pylist() for c in batch.columns)):
                own = path[len(prefix) :]
                data, lead = ranges.read_block(store, own, start, size, 1, 0)
                block = np.frombuffer(data, np.uint8)[lead:]
                before = data[lead - 1] if lead else _LINE
                inside, end = inside_quotes(block, state, before, mark)
                cuts = np.flatnonzero((block == _LINE) & ~inside) + 1
                if start == 0 or (state == OUT and before == _LINE):
                    cuts = np.concatenate(([0], cuts))
                cuts = cuts[cuts < len(block)]
                if not len(cuts):
                    continue  # all of the block belongs to a record that begins earlier
                tail = b"" if start + len(block) == 0 or data.endswith(b"\n") and end == OUT else _rest(store, own, start + len(block), end, data[-1], mark)
                body = data[lead:] + tail
                texts = []
                for a, b in zip(cuts, [*cuts[1:], len(body)]):
                    text = body[a:b].removesuffix(b"\n").removesuffix(b"\r").decode(encoding)
                    texts.append(text.removeprefix("\ufeff") if start + a == 0 else text)
                while start == 0 and texts and not texts[0]:
                    texts.pop(0)  # the header is the first line with anything in it
                yield from _batches(path, start + int(cuts[0]) == 0, texts)

    chosen = states.select("path", "length", "start", "state", "encoding")
    return ranges._spread(chosen).mapInArrow(run, "path string, first boolean, record string").filter("first OR record <> ''")


def _rest(store, path: str, at: int, state: int, before: int, mark: int) -> bytes:
    """What follows a block up to the end of the record that is open there."""
    parts = []
    for chunk in ranges.read_on(store, path, at):
        block = np.frombuffer(chunk, np.uint8)
        inside, end = inside_quotes(block, state, before, mark)
        ends = np.flatnonzero((block == _LINE) & ~inside)
        if len(ends):
            parts.append(chunk[: int(ends[0]) + 1])
            break
        parts.append(chunk)
        state, before = end, chunk[-1]
    return b"".join(parts)


def _batches(path: str, opens: bool, texts: list[str], most: int = 8 << 20):
    """Arrow batches of bounded size."""
    held, begin = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held > most or i == len(texts) - 1:
            part = texts[begin : i + 1]
            first = [opens and begin + k == 0 for k in range(len(part))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(part), pa.string()), pa.array(first, pa.bool_()), pa.array(part, pa.string())], names=["path", "first", "record"]
            )
            held, begin = 0, i + 1


def column_names(record: str | None, separator: str, has_header: bool) -> list[str]:
    """Names of the columns: from the header, else by position; empty and repeated ones get their position, as by Spark's reader."""
    fields = next(csv.reader(io.StringIO(record or "", newline=""), delimiter=separator), [])
    if not has_header:
        return [f"_c{i}" for i in range(len(fields))]
    lower = [f.lower() for f in fields]
    return [f"_c{i}" if not f else f"{f}{i}" if lower.count(f.lower()) > 1 else f for i, f in enumerate(fields)]


def parsed(records: DataFrame, separator: str, has_header: bool) -> DataFrame:
    """The records' values as text columns, by Spark's own CSV parser. The first file's header names the columns; every file's header is left out."""
    head = records.filter("first").orderBy("path").select("record").first()
    names = column_names(head.record if head else None, separator, has_header)
    if not names:
        raise ValueError("no columns: the files are empty")
    rows = records.filter("NOT first") if has_header else records.filter("record <> ''")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    options = {"sep": separator, "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    values = rows.select(F.from_csv("record", F.lit(schema), options).alias("v"))
    return values.select(*[F.col(f"v.c{i}").alias(name) for i, name in enumerate(names)])
