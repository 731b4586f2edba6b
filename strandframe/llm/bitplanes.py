"""Distances of many sets at once from bit planes.

A set becomes some hundreds of parities, or more where sets are large: each element flips the bit it hashes to. Two sets whose symmetric
difference has d elements differ in at most d parities, so the comparison never loses a pair:
it drops pairs that can't be similar enough, the exact comparison of the sets decides the rest.

Planes are stored vertically, 64 sets a word. For each plane the mismatches of all compared
words are one array operation, added to bit-sliced counters with carry-save adders. Counters start
at the highest value less the radius of their pair, so the last carry says that a pair is beyond
its radius; words in which all pairs are beyond theirs are abandoned.
"""

from __future__ import annotations

import numpy as np

LEAST_PLANES = 512
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes_for(sizes: np.ndarray) -> int:
    """Planes with which sets that share nothing differ in more parities than their radius.

    Two such sets of n elements differ in 0.62 * n of 1.3 * n planes, give or take sqrt(n) / 2, and their radius is n / 2.
    """
    return max(LEAST_PLANES, -(-13 * int(sizes.max(initial=0)) // 640) * 64)


def parities(row: np.ndarray, codes: np.ndarray, n: int, planes: int = LEAST_PLANES) -> np.ndarray:
    """[n, planes] bits of n sets of distinct codes; ``row`` has the set of each code."""
    h = ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) * np.uint64(planes) >> np.uint64(32)
    return (np.bincount(row * planes + h.view(np.int64), minlength=n * planes) & 1).astype(np.uint8).reshape(n, planes)


def vertical(bits: np.ndarray) -> np.ndarray:
    """[planes, words]: bit k of word w of a plane belongs to set 64 * w + k."""
    n = -(-len(bits) // 64) * 64
    padded = np.zeros((n, bits.shape[1]), np.uint8)
    padded[: len(bits)] = bits
    return np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def within(rows: np.ndarray, cols: np.ndarray, wanted: np.ndarray, row_size: np.ndarray, col_size: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, col) that are wanted and may be within their radius.

    ``rows`` and ``cols`` are bits [n, planes] and [m, planes]; ``wanted`` is [n, m]. The radius of a pair is
    ``share`` of the sum of its sizes.
    """
    n, m = wanted.shape
    width = -(-m // 64)
    pad = lambda x: np.pad(x, ((0, 0), (0, width * 64 - m)))
    pack = lambda x: np.ascontiguousarray(np.packbits(pad(x), axis=1, bitorder="little")).view(np.uint64)
    alive = pack(wanted)
    qi, wi = np.nonzero(alive)
    if not len(qi):
        return qi, wi
    # start values are only made for the words that are compared
    lanes = np.floor((row_size[qi][:, None] + col_size[np.minimum(wi[:, None] * 64 + np.arange(64), m - 1)]) * share + 1e-9).astype(np.int64)
    depth = 1 + max(2, int(lanes.max(initial=0)).bit_length())
    start = np.clip((1 << depth) - 1 - lanes, 0, None)
    counters = [np.packbits((start >> k & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel() for k in range(depth)]
    beyond = ~alive[qi, wi]
    planes, bits = vertical(cols), np.ascontiguousarray(rows.T)
    for j in range(0, len(planes), 4):
        x = [planes[j + i][wi] ^ (bits[j + i][qi] * ALL) for i in range(4)]
        counters[0], a = _add(counters[0], x[0], x[1])
        counters[0], b = _add(counters[0], x[2], x[3])
        counters[1], carry = _add(counters[1], a, b)
        for k in range(2, depth):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        beyond |= carry
        if j % 64 == 60:
            keep = np.flatnonzero(beyond != ALL)
            if len(keep) < len(qi):
                qi, wi, beyond, counters = qi[keep], wi[keep], beyond[keep], [c[keep] for c in counters]
                if not len(qi):
                    return qi, wi
    lanes = np.unpackbits((~beyond).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(lanes)
    return qi[at], wi[at] * 64 + lane
