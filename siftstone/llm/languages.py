"""Language ID by hyperdimensional profiles.

Every letter has a random vector of ``DIMENSIONS`` signs. An n-gram of letters is bound to one vector: the product of its letters' vectors,
each permuted (rotated) as often as letters follow it. A text is bundled to the sum of its n-grams' vectors, a language to the sum of
its texts' bundles, each brought to the same length first; a text gets the language whose prototype it makes the smallest angle with.
Signs are bits, so that binding is an exclusive or and a letter's vector follows from its code point by a hash, in any script.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, mixed, tidy

DIMENSIONS, ORDER, SEED = 2048, 3, 11
#: Code points handled at a time, and those of a long text.
GROUP_CHARS, PART_CHARS = 1 << 17, 1 << 19
#: N-grams whose signs are written out at a time; so many stay in a core's cache.
GRAMS = 256
#: Prototypes go through the driver (16 KB each); a corpus with more languages than there are in the world is refused.
MOST_LANGUAGES = 8_000
NO_LANGUAGE = "und"

_WORDS = DIMENSIONS // 64
#: What stands between words, and at both ends of a text.
_GAP = 0


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter (category L) or a mark that belongs to one."""
    out = np.zeros(0x110000, bool)
    out[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LM"]] = True
    return out


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """Random sign bits of each code point, one row each."""
    lanes = np.arange(_WORDS, dtype=np.uint64) + np.uint64(SEED << 32)
    return mixed(mixed(points.astype(np.uint64) * np.uint64(BASE) + np.uint64(1))[:, None] + mixed(lanes * np.uint64(BASE))[None, :])


def _rotated(vectors: np.ndarray, times: int) -> np.ndarray:
    """The permutation, ``times`` times over: all bits move on by one place, round the whole vector."""
    if not times:
        return vectors
    return (vectors << np.uint64(times)) | (np.roll(vectors, 1, axis=1) >> np.uint64(64 - times))


def _bound(grams: np.ndarray) -> np.ndarray:
    """Sign bits of the n-grams, given as rows of code points; a letter's vector is made once, however many n-grams have it."""
    letters, at = np.unique(grams, return_inverse=True)
    vectors, at = letter_vectors(letters), at.reshape(grams.shape)
    bound = np.zeros((len(grams), _WORDS), np.uint64)
    for i in range(grams.shape[1]):
        bound ^= _rotated(vectors, grams.shape[1] - 1 - i)[at[:, i]]
    return bound


#: The signs (-1 and 1) that each byte of sign bits stands for.
_SIGNS = 1 - 2 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)


def text_grams(text: str, order: int = ORDER, part: int = PART_CHARS):
    """The n-grams of letters of a text, as numbers, part by part: letters in lower case, one gap for whatever lies between words and at both ends.

    No n-gram is made of gaps alone; a text without letters has none.
    """
    sequence, open_gap, some = np.array([_GAP], np.uint64), True, False
    for at in range(0, len(text), part):
        points = np.frombuffer(text[at : at + part].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        there = _letters()[points]
        keep = there.copy()
        keep[1:] |= there[:-1]  # the first place of every gap stays
        keep[0] |= not open_gap
        sequence = np.concatenate((sequence, np.where(there, points, _GAP)[keep].astype(np.uint64)))
        open_gap, some = not there[-1], some or there.any()
        if at + part >= len(text) and some:
            sequence = np.concatenate((sequence, np.full(max(0 if open_gap else 1, order - len(sequence)), _GAP, np.uint64)))
        if some and len(sequence) >= order:
            out = np.zeros(len(sequence) - order + 1, np.uint64)
            for i in range(order):
                out = (out << np.uint64(21)) | sequence[i : len(out) + i]
            sequence = sequence[len(out) :]
            yield out


def _unpacked(grams: np.ndarray, order: int = ORDER) -> np.ndarray:
    return np.stack([(grams >> np.uint64(21 * (order - 1 - i))) & np.uint64(0x1FFFFF) for i in range(order)], axis=1)


def bundles(texts: list[str | None]):
    """Yields (rows, their bundles) in groups of bounded size; rows without letters are left out."""
    start = 0
    while start < len(texts):
        own, held, end = [], 0, start
        while end < len(texts) and (held < GROUP_CHARS or end == start):
            found = _counts(texts[end])
            if found is not None:
                own.append((end, *found))
            held += len(texts[end] or "")
            end += 1
        if own:
            grams = np.unique(np.concatenate([g for _, g, _ in own]))
            counts = np.zeros((len(own), len(grams)), np.float32)
            for i, (_, g, n) in enumerate(own):
                counts[i, np.searchsorted(grams, g)] = n
            total, bound = np.zeros((len(own), DIMENSIONS), np.float32), _bound(_unpacked(grams)).view(np.uint8)
            signs = np.empty((min(len(grams), GRAMS), bound.shape[1], 8), np.float32)
            for k in range(0, len(grams), GRAMS):
                part = signs[: len(grams) - k]
                np.take(_SIGNS, bound[k : k + GRAMS], axis=0, out=part, mode="clip")
                total += counts[:, k : k + GRAMS] @ part.reshape(len(part), DIMENSIONS)
            yield [row for row, *_ in own], total
        start = end


def _counts(text: str | None):
    """Distinct n-grams and how often each occurs; none for a text without letters."""
    parts = [np.unique(grams, return_counts=True) for grams in text_grams(text or "")]
    if len(parts) <= 1:
        return parts[0] if parts else None
    grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(place, np.concatenate([n for _, n in parts]), len(grams))


def is_held_out(doc_id: Column) -> Column:
    """Documents that prototypes are never learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their prototypes (one row of unit length each), learned from all rows of ``lang, text``.

    Tasks hand on one sum per language and task; sums are whole numbers, so that they do not depend on the order of the tasks.
    """

    def run(batches):
        sums = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for rows, total in bundles(texts):
                units = np.rint(total * (SCALE / np.linalg.norm(total, axis=1))[:, None]).astype(np.int64)
                of = np.array([langs[r] for r in rows], object)
                for lang in dict.fromkeys(of):
                    sums[lang] = sums.get(lang, 0) + units[of == lang].sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))], names=["lang", "sums"]
        )

    per_task = docs.mapInArrow(tidy(run), "lang string, sums array<long>")
    total = per_task.select("lang", F.posexplode("sums").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    rows = total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("sums")).select("lang", "sums.value").limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows.sort(key=lambda r: r.lang)
    table = np.array([r.value for r in rows], np.float64).reshape(len(rows), DIMENSIONS)
    return [r.lang for r in rows], table / np.maximum(np.linalg.norm(table, axis=1), 1e-300)[:, None]


#: A text's bundle counts in its language's sum as a vector of this length, in whole numbers.
SCALE = 1 << 20


def predict(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """``docs`` (with ``text``) and ``lang_pred``, ``score``: the language with the largest cosine (ties: the first one), which is cut to 0 to 1."""
    names = [c for c in docs.columns if c != "text"]
    known = docs.sparkSession.sparkContext.broadcast(table.T.copy())

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lang, score = np.full(len(texts), len(langs)), np.zeros(len(texts))
            if langs:
                for rows, total in bundles(texts):
                    cosine = (total.astype(np.float64) / np.linalg.norm(total, axis=1)[:, None]) @ known.value
                    cosine = cosine.round(9)  # the same however texts are grouped
                    lang[rows] = cosine.argmax(axis=1)
                    score[rows] = np.clip(cosine.max(axis=1), 0, 1)
            found = pa.array([*langs, NO_LANGUAGE]).take(pa.array(lang))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], found, pa.array(score)], names=[*names, "lang_pred", "score"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(tidy(run), f"{types}, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document; prototypes are learned from the rows that are not held out and have a ``lang``.

    ``held_out``: the CRC-32 of the id's decimal form leaves 2 modulo 4 (false for a null id, from which nothing is learned). A text that is null, empty
    or has no letter is ``und`` with score 0, and so is everything if there is nothing to learn from. Repeated rows count each time; equal
    texts get the same language. Texts of any length count whole. Further columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), "lang", "text")
    langs, table = prototypes(rows.filter("NOT held_out AND doc_id IS NOT NULL AND lang IS NOT NULL").select("lang", "text"))
    return predict(rows.select("doc_id", "held_out", "text"), langs, table)
