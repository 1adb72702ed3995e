"""Words of many texts at once, as 64-bit hashes, straight from Arrow buffers.

A word is a run of bytes other than space and 0x09-0x0D, after A-Z become lower
case.  Its hash is a polynomial over its bytes modulo 2**64, finished by a mixer;
all words of a block of texts are hashed with a few passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
BLOCK = 1 << 20  # bytes of text at a time; a longer text is a block of its own
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers_of(BASE, size), _powers_of(pow(BASE, -1, 1 << 64), size)


@lru_cache(maxsize=2)
def _values(lower: bool = True) -> np.ndarray:
    """Byte values, in lower case unless told otherwise, plus one; 0 for what parts words."""
    v = np.arange(256) + 1
    if lower:
        v[65:91] += 32
    v[9:14] = v[32] = 0
    return v.astype(np.uint64)


def text_blocks(texts: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of runs of texts; nulls are empty."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    if texts.null_count:  # a null may lie over bytes
        keep = texts.fill_null("").cast(pa.large_string())
        yield from text_blocks(keep, block)
        return
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + block, side="right")) - 1)
        yield i, data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, starts and ends of the words, and each text's first word (with a closing total)."""
    value = _values(lower)[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = value > 0
    begins, stops = inside.copy(), np.zeros(len(data) + 1, bool)
    begins[1:] &= ~inside[:-1]
    stops[1:] = inside[:-1] & ~inside[1:]
    seam = offsets[1:-1]
    seam = seam[(seam > 0) & (seam < len(data))]
    joined = seam[inside[seam] & inside[seam - 1]]  # a word of one text right before a word of the next
    begins[joined] = stops[joined] = True
    starts = np.flatnonzero(begins)
    return value, starts, np.flatnonzero(stops), np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes in order, and each text's first word (with a closing total)."""
    value, starts, ends, first = word_spans(data, offsets)
    size = max(BLOCK, 1 << max(1, len(data)).bit_length()) + 1
    powers, inverse = _powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value * powers[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), first


_STEPS = mix(np.arange(1, 65, dtype=np.uint64)) | _U(1)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of the whole sequence where there are fewer, but not none."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out += words[i : n - k + 1 + i] * _STEPS[i]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
