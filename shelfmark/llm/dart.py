"""DartMinHash: signatures of weighted sets by throwing hashed darts into the regions of their elements.

Every element owns an endless strip of darts over (weight, rank), a Poisson process of density one that depends on the element alone.
The strip is cut into weight bands [0,1), [1,2), [2,4), [4,8) ...; in a band the darts arrive at exponential rank gaps, so the first
few come cheaply.  A set sees the darts below its weights; each belongs to one of `k` coordinates, and a coordinate keeps the earliest.
Two sets agree in a coordinate with the probability sum(min) / sum(max) of their weights.
"""

from __future__ import annotations

import numpy as np

from shelfmark.llm.words import mix

STEP = np.uint64(0x9E3779B97F4A7C15)
PLACE = np.uint64(0xD1B54A32D192ED03)
NAME = np.uint64(0x8CB92BA72F3D8DD7)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _darts(keys: np.ndarray, weights: np.ndarray, limit: float):
    """(rank, name) of all darts with rank below limit."""
    ranks, names = [], []
    band, low, width = 1, 0.0, 1.0
    keep = np.arange(len(keys))
    while len(keep):
        seeds, tops = mix(keys[keep] + np.uint64(band * int(STEP) % 2**64)), weights[keep]
        expected = limit * width
        block = int(expected + 4 * np.sqrt(expected) + 4)
        rows, begun, first = np.arange(len(keep)), np.zeros(len(keep)), 1
        while len(rows):
            steps = np.arange(first, first + block, dtype=np.uint64) * STEP
            hashed = mix(seeds[rows][:, None] + steps)
            at = begun[:, None] + np.cumsum(-np.log(_uniform(hashed)), axis=1) / width
            inside = at < limit
            chosen, of = hashed[inside], np.nonzero(inside)[0]
            seen = low + width * _uniform(mix(chosen ^ PLACE)) < tops[rows[of]]
            ranks.append(at[inside][seen])
            names.append(chosen[seen])
            more = inside[:, -1]
            rows, begun, first = rows[more], at[more, -1], first + block
        low, width = low + width, width if band == 1 else 2 * width
        keep = keep[weights[keep] > low]
        band += 1
    return np.concatenate(ranks), np.concatenate(names)


def signature(keys: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The name of the earliest dart of each of k coordinates.  keys: distinct 64-bit hashes, weights > 0."""
    limit = (np.log(k) + 2.5) * k / float(weights.sum())
    while True:
        ranks, names = _darts(keys, weights, limit)
        names = mix(names ^ NAME)
        order = np.argsort(-ranks, kind="stable")
        coordinate = (names[order] % np.uint64(k)).astype(np.intp)
        out, full = np.zeros(k, np.uint64), np.zeros(k, bool)
        out[coordinate] = names[order]  # the last write, of the smallest rank, stays
        full[coordinate] = True
        if full.all():
            return out
        limit *= 1.5


def common_weight(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """sum(min) of two weighted sets given as sorted keys and weights."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return float(np.minimum(wa[i], wb[j]).sum())


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """sum(min) / sum(max)."""
    common = common_weight(a, wa, b, wb)
    return common / (float(wa.sum()) + float(wb.sum()) - common)


def excess(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and weights of what a has beyond b."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    rest = wa.copy()
    rest[i] -= np.minimum(wa[i], wb[j])
    return a[rest > 0], rest[rest > 0]
