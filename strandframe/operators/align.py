"""Global pairwise alignment of texts with affine gaps, for showing how two records differ."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 1, -1, -6, -1
LOWEST = -(1 << 30)
#: Pairs that are aligned at once, and the most cells of their tables (each three layers of two bytes).
LANES, CELLS = 512, 10_000_000


def global_alignment(a: str, b: str) -> tuple[str, str]:
    """Both texts with gaps. Three layers: pair (0), gap in b (1), gap in a (2); a pair is preferred in ties.

    Each row is a few array operations; a byte a cell keeps the layers that the cell's three layers come from.
    """
    n, m = len(a), len(b)
    other = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
    column, new = np.arange(m + 1), GAP_OPEN + GAP_EXTEND
    back = np.zeros((n + 1, m + 1), np.uint8)
    above = np.full((3, m + 1), LOWEST)
    for i in range(n + 1):
        row = np.full((3, m + 1), LOWEST)
        source = np.zeros((3, m + 1), np.uint8)
        if i:
            pair = np.where(other == ord(a[i - 1]), MATCH, MISMATCH)
            source[0, 1:] = above[:, :-1].argmax(axis=0)
            row[0, 1:] = above[:, :-1].max(axis=0) + pair
            down = np.stack([above[0] + new, above[1] + GAP_EXTEND, above[2] + new])
            source[1], row[1] = down.argmax(axis=0), down.max(axis=0)
        else:
            row[0, 0] = 0
        # a gap in a begins after the best cell to the left, less its length
        best = np.maximum(row[0], row[1]) - GAP_EXTEND * column
        row[2, 1:] = np.maximum(np.maximum.accumulate(best)[:-1] + GAP_OPEN + GAP_EXTEND * column[1:], LOWEST)
        along = np.stack([row[0, :-1] + new, row[1, :-1] + new, row[2, :-1] + GAP_EXTEND])
        source[2, 1:] = along.argmax(axis=0)
        back[i] = source[0] | source[1] << 2 | source[2] << 4
        above = row
    layer = int(above[:, m].argmax())
    i, j, x, y = n, m, [], []
    while i or j:
        before = int(back[i, j]) >> 2 * layer & 3
        x.append(a[i - 1] if layer != 2 else "-")
        y.append(b[j - 1] if layer != 1 else "-")
        i, j = i - (layer != 2), j - (layer != 1)
        layer = before
    return "".join(reversed(x)), "".join(reversed(y))


def global_alignments(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The same as ``global_alignment`` of each pair, many at once; only a pair of more than ``CELLS`` cells is done on its own.

    Pairs of like lengths share their array operations.
    """
    out: list[tuple[str, str]] = [("", "")] * len(pairs)
    layers: list[np.ndarray] = []
    group: list[int] = []
    n = m = 0
    for k in sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]) // 8, len(pairs[k][1]) // 8)):
        own = len(pairs[k][0]), len(pairs[k][1])
        if _cells(*own) > CELLS:
            out[k] = global_alignment(*pairs[k])
            continue
        most = max(n, own[0]), max(m, own[1])
        if group and (len(group) == LANES or _cells(*most) * (len(group) + 1) > CELLS):
            for g, x in zip(group, _align_group([pairs[g] for g in group], layers)):
                out[g] = x
            group, most = [], own
        group.append(k)
        n, m = most
    if group:
        for g, x in zip(group, _align_group([pairs[g] for g in group], layers)):
            out[g] = x
    return out


def _cells(n: int, m: int) -> int:
    return (n + m + 1) * (min(n, m) + 1)


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _align_group(pairs: list[tuple[str, str]], layers: list[np.ndarray]) -> list[tuple[str, str]]:
    """Alignments of some pairs by antidiagonals of all their tables; ``layers`` keeps the memory for the next group.

    Scores are kept without the extension of gaps, that is plus one a letter of both texts, so they are never much below 0.
    Cells beyond a text's end don't reach those within.
    """
    number = len(pairs)
    texts = [[p[0] for p in pairs], [p[1] for p in pairs]]
    lengths = [np.array([len(t) for t in own], np.int64) for own in texts]
    codes = [_codes(own) for own in texts]
    n, m = (int(x.max()) for x in lengths)
    # antidiagonals are indexed by the shorter side (1: that of a), the other side runs backwards along them
    by_a = n <= m
    p, q = (n, m) if by_a else (m, n)
    small = codes
    if max((int(c.max()) for c in codes if len(c)), default=0) >= 1 << 13:
        ranks = np.unique(np.concatenate(codes), return_inverse=True)[1]
        small = [ranks[: len(codes[0])], ranks[len(codes[0]) :]]
    kind = np.int16 if 3 * p < 1 << 14 and max((int(c.max()) for c in small if len(c)), default=0) < 1 << 13 else np.int32
    extend = -GAP_EXTEND
    match, differ, low = MATCH + 2 * extend, MATCH - MISMATCH, 4 * GAP_OPEN

    def grid(own: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
        x = np.zeros((number, most), kind)
        x[np.arange(most) < size[:, None]] = own * differ
        return np.ascontiguousarray(x.T)

    a, b = grid(small[0], lengths[0], n), grid(small[1], lengths[1], m)
    short, long = (a, b[::-1].copy()) if by_a else (b, a[::-1].copy())
    shape = (p + q + 1, p + 1, number)
    flat = int(np.prod(shape))
    if not layers or layers[0].size < flat or layers[0].dtype != kind:
        layers[:] = [np.empty(flat, kind) for _ in range(3)]
    pair, down, along = (x[:flat].reshape(shape) for x in layers)
    best = [np.empty((p + 1, number), kind) for _ in range(3)]
    opened, work = np.empty((p + 1, number), kind), np.empty((p + 1, number), kind)
    # ``first`` gives a gap that takes a letter of the shorter side, ``other`` one of the longer side
    first, other = (down, along) if by_a else (along, down)
    for d in range(p + q + 1):
        now, before, two = best[d % 3], best[(d - 1) % 3], best[(d - 2) % 3]
        if d <= q:  # no letter of the shorter side
            pair[d, 0] = first[d, 0] = low
            other[d, 0] = GAP_OPEN if d else low
            if not d:
                pair[0, 0] = 0
            now[0] = GAP_OPEN if d else 0
        if 0 < d <= p:  # none of the longer
            pair[d, d] = other[d, d] = low
            first[d, d] = GAP_OPEN
            now[d] = GAP_OPEN
        lo, hi = max(1, d - q), min(p, d - 1) + 1
        if lo < hi:
            w = work[lo:hi]
            np.bitwise_xor(short[lo - 1 : hi - 1], long[q - d + lo : q - d + hi], out=w)
            np.minimum(w, differ, out=w)
            np.subtract(match, w, out=w)
            x, y, z = pair[d, lo:hi], first[d, lo:hi], other[d, lo:hi]
            np.add(two[lo - 1 : hi - 1], w, out=x)
            np.maximum(first[d - 1, lo - 1 : hi - 1], opened[lo - 1 : hi - 1], out=y)
            np.maximum(other[d - 1, lo:hi], opened[lo:hi], out=z)
            np.maximum(x, y, out=w)
            np.maximum(w, z, out=now[lo:hi])
        at = slice(max(0, d - q), min(p, d) + 1)
        np.add(now[at], GAP_OPEN, out=opened[at])
    return _written(codes, lengths, _steps(pair, down, along, lengths, by_a))


def _steps(pair: np.ndarray, down: np.ndarray, along: np.ndarray, lengths: list[np.ndarray], by_a: bool) -> np.ndarray:
    """The layers that the alignments go through, a row a pair, from the first letter to the last at the row's end; 3 before the first."""
    _, width, number = pair.shape
    tables = [x.reshape(-1) for x in (pair, down, along)]
    # what each layer's score loses on the way into a layer; 3 stands for an end that is looked for or was reached
    loss = np.zeros((3, 4), np.int64)
    loss[:, 1] = [GAP_OPEN, 0, GAP_OPEN]
    loss[:, 2] = [GAP_OPEN, GAP_OPEN, 0]
    take_a, take_b = np.array([1, 1, 0, 0]), np.array([1, 0, 1, 0])
    i, j, lane, layer = lengths[0].copy(), lengths[1].copy(), np.arange(number), np.full(number, 3)
    back = []
    while True:
        at = ((i + j) * width + (i if by_a else j)) * number + lane
        x, y, z = (t.take(at) + o.take(layer) for t, o in zip(tables, loss))
        layer = np.where((x >= y) & (x >= z), 0, np.where(y >= z, 1, 2))
        layer[i + j == 0] = 3
        if (layer == 3).all():
            break
        back.append(layer.astype(np.uint8))
        i -= take_a.take(layer)
        j -= take_b.take(layer)
    return np.ascontiguousarray(np.array(back[::-1], np.uint8).reshape(len(back), number).T)


def _written(codes: list[np.ndarray], lengths: list[np.ndarray], steps: np.ndarray) -> list[tuple[str, str]]:
    """Both texts of each pair with their gaps: letters fill, in order, the steps that take one."""
    ends = np.cumsum((steps != 3).sum(axis=1)).tolist()
    steps = steps[steps != 3]
    texts = []
    for own, without in zip(codes, (2, 1)):
        x = np.full(len(steps), ord("-"), np.uint32)
        x[steps != without] = own
        text = x.tobytes().decode("utf-32-le", "surrogatepass")
        texts.append([text[s:e] for s, e in zip([0, *ends], ends)])
    return list(zip(*texts))


def aligned(a: Column, b: Column) -> Column:
    """struct(a, b) with gaps; null if either is null."""

    @F.pandas_udf("struct<a:string,b:string>")  # type: ignore[call-overload]
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out: list[tuple] = [(None, None)] * len(x)
        known = [(k, (p, q)) for k, (p, q) in enumerate(zip(x, y)) if p is not None and q is not None]
        for (k, _), texts in zip(known, global_alignments([t for _, t in known])):
            out[k] = texts
        return pd.DataFrame(out, columns=["a", "b"])

    return run(a, b)
