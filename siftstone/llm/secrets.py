"""Secret scans with one combined deterministic automaton.

All rules are compiled into two kinds of transition arrays: one automaton of the reversed rules, run once
from the last byte of a text to the first, marks every byte at which some rule can begin; from these marks the forward
automaton of that rule finds the longest match. Per rule the matches are leftmost, longest and do not overlap.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import backwards, compile_rules, parse
from .common import byte_buffer, tidy


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``head`` then ``tail``. A match whose tail has fewer than ``least`` bytes is dropped after matching."""

    kind: str
    head: str
    tail: str
    least: int = 0


#: The base kinds come first, in this order. A run of hexadecimal digits is the same match whether its length is asked
#: for in the expression or afterwards; asking in the expression keeps every short run from being a mark.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+", 12),
    Rule("access", "", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "", "[0-9a-f]{16,}", 16),
)
EXTRA_RULES = (
    Rule("private_key", "", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("web_token", "", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("forge_token", "gh[pousr]_", "[A-Za-z0-9]+", 36),
    Rule("chat_token", "xox[abprs]-", "[A-Za-z0-9-]+", 10),
    Rule("cloud_key", "AIza", "[A-Za-z0-9_-]+", 35),
    Rule("url_login", r"://[A-Za-z0-9._%+-]+:", r"[^\x00-\x20/@:]+@", 4),
)
RULES = BASE_RULES + EXTRA_RULES


class Scanner:
    """Compiled rules. Built on the driver once; the arrays travel with the task."""

    def __init__(self, rules=RULES):
        self.rules = rules
        nodes = [parse(r.head + r.tail) for r in rules]
        self.starts = compile_rules([backwards(n) for n in nodes], anywhere=True)
        self.spans = [compile_rules([n], anywhere=False) for n in nodes]
        self._ready = None

    def __getstate__(self):
        return {**self.__dict__, "_ready": None}

    def _rows(self):
        if self._ready is None:
            heads = [re.compile(r.head.encode()) for r in self.rules]
            self._ready = self.starts.rows()[0], [a.rows()[0] for a in self.spans], heads
        return self._ready

    def find(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, by start and then rule."""
        row, spans, heads = self._rows()
        marks, n = [], len(text)
        for i, c in enumerate(text.translate(self.starts.classes)[::-1], 1):
            row = row[c]
            if row[-2]:
                marks.append((n - i, row[-2]))
        if not marks:
            return []
        found = []
        marks.reverse()
        for k, (rule, automaton, first) in enumerate(zip(self.rules, self.spans, spans)):
            free = 0
            for start, bits in marks:
                if bits >> k & 1 and start >= free:
                    state, classes, end = first, automaton.classes, start
                    for i in range(start, n):
                        state = state[classes[text[i]]]
                        if state[-2]:
                            end = i + 1
                        elif state[-1]:
                            break
                    free = end
                    if end - start - heads[k].match(text, start, end).end() + start >= rule.least:
                        found.append((start, end, k))
        found.sort(key=lambda s: (s[0], s[2]))
        return found


def _code_points(text: bytes, found):
    """Byte spans as code point spans."""
    if text.isascii():
        return found
    ends = sorted({p for a, b, _ in found for p in (a, b)})
    at, last, place = {}, 0, 0
    for p in ends:
        place += len(text[last:p].decode())
        at[p], last = place, p
    return [(at[a], at[b], k) for a, b, k in found]


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """``doc_id, spans array<struct<kind, start, end>>`` per row of ``docs(doc_id, text)``.

    Positions count code points, the end is exclusive; spans are sorted by start, then by the order of the rules. Null and empty texts have
    none; every row, also a repeated one or one with a null id, gives one row.
    """
    scanner = Scanner(tuple(rules))
    kinds = [r.kind for r in rules]
    fields = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in batches:
            data, offsets = byte_buffer(batch.column(1))
            whole, cuts, out = data.tobytes(), offsets.tolist(), []
            for a, b in zip(cuts[:-1], cuts[1:]):
                text = whole[a:b]
                found = scanner.find(text)
                out.append([{"kind": kinds[k], "start": s, "end": e} for s, e, k in _code_points(text, found)] if found else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(fields))], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        tidy(run), "doc_id long, spans array<struct<kind string, start long, end long>>"
    )


def joined(spans):
    """Spans as ``kind:start:end`` joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def span_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules=RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``, overlapping spans once; ``n_chars`` follows the new text.

    All rows and columns stay; null texts stay null; texts without secrets stay as they are.
    """
    scanner, columns = Scanner(tuple(rules)), docs.columns
    where, text_schema = columns.index("text"), docs.schema

    def run(batches):
        for batch in batches:
            texts = batch.column(where).to_pylist()
            for i, text in enumerate(texts):
                if text:
                    raw = text.encode()
                    found = scanner.find(raw)
                    if found:
                        parts, at = [], 0
                        for a, b, _ in found:
                            if b > at:
                                parts += [raw[at:a], mark.encode()] if a >= at else []
                                at = b
                        texts[i] = b"".join([*parts, raw[at:]]).decode()
            arrays = list(batch.columns)
            arrays[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    out = docs.mapInArrow(tidy(run), text_schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
