"""Anchors of fixed-length windows in byte strings, vectorised with numpy.

Every window of `min_len` bytes is represented by the smallest hashed k-gram inside
it (a minimizer).  Two equal windows hold the same k-grams in the same places, so they
choose the same anchor; consecutive windows mostly share one, which makes a run of
window starts.  Runs whose anchor occurs once in the corpus can hold no repeat.
"""

from __future__ import annotations

import numpy as np

KGRAM = 40
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_POS_BITS = 21
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, inverse, np.uint64)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)  # wraps modulo 2**64
        np.cumprod(down, out=down)
        _powers = up, down
    return _powers


def kgram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit polynomial hash of each k bytes of data."""
    n = len(data)
    up, down = _power_tables(max(n, 2 * BLOCK))
    with np.errstate(over="ignore"):
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= up[:n]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        h = sums[k:] - sums[:-k]
        h *= down[: n - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values: prefix and suffix minima of blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def runs_of(data: np.ndarray, offsets: np.ndarray, min_len: int, k: int = KGRAM):
    """Runs of window starts that share an anchor; documents begin at `offsets`
    (the last entry is the length of data).

    Returns the document's number, first and last window start and anchor (in data) and
    the anchor's hash for each run.  No window crosses documents.
    """
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < min_len:
        return empty, empty, empty, empty, empty
    hashes = kgram_hashes(data, k)
    low = np.uint64((1 << _POS_BITS) - 1)
    packed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (sliding_min(packed, min_len - k + 1) & low).astype(np.int64)  # leftmost of equal k-grams
    first, last = offsets[:-1], offsets[1:] - min_len
    has = last >= first
    valid = np.zeros(n + 1, np.int32)
    np.add.at(valid, first[has], 1)
    np.add.at(valid, last[has] + 1, -1)
    valid = np.cumsum(valid)[: len(anchor)] > 0
    begins = np.empty(len(anchor), bool)
    begins[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=begins[1:])
    begins[first[has]] = True
    begins &= valid
    start = np.flatnonzero(begins)
    doc = np.searchsorted(offsets, start, side="right") - 1
    end = np.minimum(np.append(start[1:] - 1, n), last[doc])
    return doc, start, end, anchor[start], hashes[anchor[start]].view(np.int64)
