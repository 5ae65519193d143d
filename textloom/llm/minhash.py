"""Shingle sets and b-bit MinHash signatures, whole batches at a time."""

from __future__ import annotations

import numpy as np

from .winnow import mix, word_hashes, words_of

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(77)
_A, _B, _C = (np.uint64(int(x) | 1) for x in _rng.integers(1, 1 << 62, 3))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each document's word shingles end to end (repeats included), and n+1 offsets.

    A document of fewer words has one shingle, all its words; without words it has none.
    """
    if lower:
        data = LOWER[data]
    starts, ends, bounds = words_of(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    h = word_hashes(data, starts, ends)
    n_words = np.diff(bounds)
    full = mix(h * _A)
    whole = full.copy()
    for j in range(1, size):
        if len(full) > 1:
            nxt = np.roll(h, -j)
            full = mix(full + nxt * _B + np.uint64(j))
    counts = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    out_off = np.concatenate([[0], np.cumsum(counts)])
    keep = np.zeros(len(h), bool)
    begin = bounds[:-1][n_words > 0]
    reach = bounds[1:][n_words > 0]
    take = np.maximum(reach - size + 1, begin + 1)
    change = np.zeros(len(h) + 1, np.int32)
    np.add.at(change, begin, 1)
    np.add.at(change, take, -1)
    keep = np.cumsum(change[:-1]) > 0
    few = np.flatnonzero((n_words > 0) & (n_words < size))
    for d in few:  # hash of fewer words, never equal to a shingle's
        x = whole[bounds[d] : bounds[d] + 1]
        for j in range(1, n_words[d]):
            x = mix(x + h[bounds[d] + j] * _B + np.uint64(j))
        full[bounds[d]] = mix(x ^ _C)[0]
    return full[keep], out_off


def multipliers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


def signatures(shingles: np.ndarray, offsets: np.ndarray, n: int, bits: int = 16, seed: int = 11) -> np.ndarray:
    """MinHash of n functions, ``bits`` bits of each kept (documents without shingles: zeros)."""
    out = np.zeros((len(offsets) - 1, n), np.uint16 if bits <= 16 else np.uint32)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if not len(some):
        return out
    starts = offsets[:-1][some]
    a, b = multipliers(n, seed)
    work = np.empty_like(shingles)
    for i in range(n):
        np.multiply(shingles, a[i], out=work)
        work += b[i]
        out[some, i] = mix(np.minimum.reduceat(work, starts)) >> np.uint64(64 - bits)
    return out
