"""Words and shingles of whole Arrow batches as 64-bit hashes, in numpy.

A word is a run of bytes outside ``\\x20\\x09-\\x0D``. All functions work on the
flat bytes of many texts at once, so their cost is a few passes over memory.
Batches are cut into slices of bounded bytes; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (one longer text is its own slice).
SLICE_BYTES = 1 << 20
U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _seeded(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(_ODD) + U64(seed))


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = _ODD, pow(_ODD, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, dtype=U64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U64))
    return out[0], out[1]


@lru_cache(8)
def byte_codes(lower: bool, strip: bool) -> np.ndarray:
    """A random code for each byte; 0 for bytes that leave no trace (``strip``: ASCII punctuation)."""
    t = _seeded(256, 7)
    if lower:
        t[65:91] = t[97:123]
    if strip:
        for b in range(33, 127):
            if not chr(b).isalnum():
                t[b] = 0
    return t


#: Called once before words are read: what another operator left in this worker's memory goes.
RELEASE: list = []

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def raw(texts: pa.Array, release: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    while RELEASE and release:
        RELEASE.pop()()
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not (pa.types.is_large_string(texts.type) or pa.types.is_string(texts.type)):
        texts = texts.cast(pa.large_string())
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """Words of some texts: ``h`` their hashes, ``at`` where each text's words begin, ``start``/``end`` their bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, strip: bool = False, hashes: bool = True):
        n = len(data)
        word = ~IS_SPACE[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        edges = offsets[:-1][(offsets[:-1] < n)]
        first[edges] = word[edges]
        ends = offsets[1:][offsets[1:] > 0] - 1
        last[ends] = word[ends]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, offsets)
        if hashes:
            self.h = self._hash(data, lower, strip)
            if strip:
                self._drop(self.h != mix(np.zeros(1, U64))[0])

    def _hash(self, data: np.ndarray, lower: bool, strip: bool) -> np.ndarray:
        n = len(data)
        up, down = _powers(1 << max(20, int(n).bit_length()))
        sums = np.empty(n + 1, dtype=U64)
        sums[0] = 0
        np.cumsum(byte_codes(lower, strip)[data] * up[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])

    def _drop(self, keep: np.ndarray) -> None:
        if keep.all():
            return
        seen = np.concatenate(([0], np.cumsum(keep)))
        self.at = seen[self.at]
        self.start, self.end, self.h = self.start[keep], self.end[keep], self.h[keep]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)


@lru_cache(16)
def _weights(k: int) -> np.ndarray:
    return _seeded(k, 1234567 * k) | U64(1)


def shingles(words: np.ndarray, at: np.ndarray, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs, text after text, and where each text's runs begin.

    With ``whole``, a text of 1 to k-1 words has one run: all its words.
    """
    n, counts = len(words), np.diff(at)
    w = _weights(k)
    runs = np.zeros(max(n - k + 1, 0), dtype=U64)
    for j in range(k):
        runs += words[j : n - k + 1 + j] * w[j] if n >= k else 0
    full = np.maximum(counts - k + 1, 0)
    if not whole:
        keep = _positions(at[:-1], full)
        return mix(runs[keep]), np.concatenate(([0], np.cumsum(full)))
    short = np.flatnonzero((counts > 0) & (counts < k))
    sizes = full.copy()
    sizes[short] = 1
    out_at = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(out_at[-1], dtype=U64)
    if len(short):
        is_short = np.zeros(out_at[-1], dtype=bool)
        is_short[out_at[short]] = True
        out[~is_short] = mix(runs[_positions(at[:-1], full)])
        sums = np.zeros(len(short), dtype=U64)
        for j in range(k - 1):
            has = counts[short] > j
            sums[has] += words[at[short[has]] + j] * w[j]
        out[out_at[short]] = mix(sums + counts[short].astype(U64) * U64(_ODD))
    else:
        out[:] = mix(runs[_positions(at[:-1], full)])
    return out, out_at


def _positions(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[i], first[i]+1, ... sizes[i] of them, for every i."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(first - (ends - sizes), sizes)


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each group."""
    group = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, group))
    v, g = values[order], group[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
    v, g = v[new], g[new]
    return v, np.searchsorted(g, np.arange(len(at)))


def group_min(values: np.ndarray, at: np.ndarray, empty: int = 0) -> np.ndarray:
    """Smallest value of each group."""
    return _reduce(np.minimum, values, at, empty)


def group_sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _reduce(np.add, values, at, 0)


def _reduce(f: np.ufunc, values: np.ndarray, at: np.ndarray, empty: int) -> np.ndarray:
    out = np.full(len(at) - 1, empty, dtype=values.dtype)
    filled = np.flatnonzero(np.diff(at) > 0)
    if len(filled):
        out[filled] = f.reduceat(values, at[:-1][filled])
    return out
