"""Word shingles of whole texts as sorted sets of 64-bit hashes, computed a batch at a time with numpy.

Words are runs of bytes other than space and 0x09 to 0x0D, A to Z in lower case. Each word
is hashed from prefix sums of a polynomial, each shingle from its words' hashes in turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_K = np.uint64(0xBF58476D1CE4E5B9)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """The first n powers of the polynomial's base and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_P, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers


def _stir(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= _K
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one more for the end)."""
    low = _LOWER[data]
    dark = ~_SPACE[data]
    start = dark.copy()
    start[1:] &= ~dark[:-1]
    texts = offsets[:-1][offsets[:-1] < len(data)]
    start[texts] = dark[texts]  # a text's first byte starts a word whatever comes before
    stop = dark.copy()
    stop[:-1] &= ~dark[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    stop[lasts] = dark[lasts]
    first, last = np.flatnonzero(start), np.flatnonzero(stop)
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    h = (sums[last + 1] - sums[first]) * inverse[first]
    h += (last - first).astype(np.uint64) * _P
    return _stir(h), np.searchsorted(first, offsets)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each word on; the last k - 1 are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = _stir((h + words[i : i + n]) * _P)
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its offsets into them."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.empty(0, np.uint8)
    return raw, at - at[0]


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty without words, one shingle with fewer than k words."""
    data, offsets = text_buffers(column.fill_null("") if column.null_count else column)
    if not len(data):
        for _ in range(len(column)):
            yield np.empty(0, np.uint64)
        return
    words, bounds = word_hashes(data, offsets)
    whole = shingle_hashes(words, k)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            found = np.sort(whole[a : b - k + 1])
            yield found[np.concatenate(([True], found[1:] != found[:-1]))]
        else:
            yield shingle_hashes(words[a:b], b - a) if b > a else np.empty(0, np.uint64)
