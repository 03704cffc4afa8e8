"""Words of UTF-8 text as arrays: spans and 64-bit hashes of a whole batch at once, without a Python loop over words.

A word is a longest run of bytes that are digits, letters (A-Z lower-cased) or above 0x7F.
"""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: np.uint64, count: int) -> np.ndarray:
    kept = _POWERS.get(str(base))
    if kept is None or len(kept) < count:
        steps = np.full(max(count, 1 << 16), base, np.uint64)
        steps[0] = 1
        kept = _POWERS[str(base)] = np.multiply.accumulate(steps)
    return kept[:count]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, number of words before each text).  Words never cross texts."""
    low = LOWER[data]
    inside = IS_WORD[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside))
    after = np.concatenate((inside, [False]))
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return low, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each word by prefix sums modulo 2**64, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.empty(len(low) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(low)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(BASE_INVERSE, len(low))[starts])


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive words (one entry for every start with a whole run)."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(size):
        out = (out * np.uint64(0x100000001B3)) ^ hashes[k : k + count]
        out = out * BASE
    return mix(out)
