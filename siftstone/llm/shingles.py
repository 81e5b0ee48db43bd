"""Word shingles and HyperMinHash sketches of texts, as numpy work on byte buffers."""

from __future__ import annotations

import hashlib

import numpy as np

from .common import byte_codes, gram_hashes, mixed, row_groups, words

WORDS = 5
BANDS, BAND_ROWS = 40, 4
REGISTERS = BANDS * BAND_ROWS
#: A register holds the count of leading zeros of the smallest hash of its bucket above this many mantissa bits.
MANTISSA = 10

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CODES = byte_codes(41)
_CODES[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS):
    """Yields (row, sorted distinct 64-bit hashes) of every text's shingles; a shorter text is one shingle, an empty one has none."""
    for first, last in row_groups(offsets):
        base = offsets[first]
        row, _, _, h = words(data[base : offsets[last]], offsets[first : last + 1] - base, _SPACE, _CODES)
        cuts = np.searchsorted(row, np.arange(last - first + 1))
        grams = mixed(gram_hashes(h, size)) if len(h) >= size else h[:0]
        for i in range(last - first):
            a, b = cuts[i], cuts[i + 1]
            if b - a >= size:
                own = np.sort(grams[a : b - size + 1])
                yield first + i, own[np.concatenate(([True], own[1:] != own[:-1]))]
            else:
                yield first + i, mixed(gram_hashes(h[a:b], int(b - a))) if b > a else h[:0]


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _probes() -> np.ndarray:
    """For every register the order in which an empty one looks for a full one (fixed)."""
    random = np.random.default_rng(43)
    return np.stack([random.permutation(REGISTERS) for _ in range(REGISTERS)])


PROBES = _probes()


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set of sorted hashes; 0 marks an empty one.

    The upper half of a hash deals it to a bucket; hashes are sorted, so a bucket's first one is its smallest. What is left of the
    hash, as a fraction, is kept like a floating point number: leading zeros and some mantissa bits. Smaller fractions have larger registers.
    """
    high = hashes >> np.uint64(32)
    scaled = high * np.uint64(REGISTERS)
    bucket = (scaled >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else bucket
    # the fraction within the bucket, in 52 bits, so that it is exact as a double
    rest = ((scaled[first] & np.uint64(0xFFFFFFFF)) << np.uint64(20)) | ((hashes[first] & np.uint64(0xFFFFFFFF)) >> np.uint64(12))
    mantissa, exponent = np.frexp(rest.astype(np.float64) + 1.0)
    zeros = 53 - exponent
    out = np.zeros(REGISTERS, np.uint16)
    out[bucket[first]] = (zeros + 1) << MANTISSA | ((mantissa * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    return out


def filled(registers: np.ndarray) -> np.ndarray:
    """Empty registers take over the first full one of their probing order, so that a band of a small set still means something."""
    empty = np.flatnonzero(registers == 0)
    if not len(empty) or len(empty) == len(registers):
        return registers
    order = PROBES[empty]
    source = order[np.arange(len(empty)), np.argmax(registers[order] != 0, axis=1)]
    out = registers.copy()
    out[empty] = registers[source]
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    rows = filled(registers).reshape(BANDS, BAND_ROWS).astype(np.uint64)
    key = rows[:, 0]
    for j in range(1, BAND_ROWS):
        key = key << np.uint64(16) | rows[:, j]
    return mixed(key + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of registers and the number of registers they rest on.

    Equal full registers count as matches, less the share that different sets would match by chance.
    """
    full = (a != 0) | (b != 0)
    used = full.sum(-1)
    equal = ((a == b) & full).sum(-1) / np.maximum(used, 1)
    by_chance = 1 / (3 << MANTISSA)
    return np.maximum((equal - by_chance) / (1 - by_chance), 0), used
