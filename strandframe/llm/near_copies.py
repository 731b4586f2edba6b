"""Records that share most of their content in spite of small edits, insertions and changed order.

Two records are linked if the distinct substrings of ``k`` characters common to both are at least
``threshold`` of the distinct ones in either. The steps:

1. Texts are packed (two bits a letter where only A, C, G and T occur); exact copies become one class with one representative.
2. Windows of ``PART`` letters are counted in a table of fixed size over all representatives. A window more frequent than
   ``COMMON_LEAST`` and than twice what chance puts into its place of the table is common (shared ends and the like) where the next or the last one is too.
3. Each representative gets a sketch: the smallest hashes of its windows of ``width`` letters of which common ones cover at most
   ``COVERED`` (a window of some letters beside a shared end would tell little more than the end).
   ``width`` follows from the letters of the whole table, so that unrelated records share a value by chance in less than
   ``CHANCE`` cases a record; the more windows are left out, the larger the sketch (see ``sketch_size``). A record with fewer windows
   than that gives all of them, so no link is left to chance. Records that are short, repeat themselves or have too little
   beside common windows get ``BANDS`` min-hash bands of ``ROWS`` values each of the substrings of ``k`` characters instead.
4. Records with a sketch value in common are pairs. Two that share more than one value are joined, so are the records of a value of
   more than ``GROUP`` records or of a band (to the smallest number among them, never in all pairs). A sketch value of more than
   ``COMMON_TOTAL`` records joins none of them; all its records get bands. Connected components of what is joined are candidates.
5. Components are compared in blocks by bit planes (see ``bitplanes``), then exactly by their sets. A component
   larger than a block is cut into blocks by hash, and each pair of blocks is a task of its own.
6. Pairs of one shared value whose records are in different components are mostly chance. Each is compared on its own, so chance
   adds pairs in proportion to the records, but never joins components.

Values travel in chunks: a task sorts the values of many records, closes what is common in it already (a band becomes a star on
the spot, a value above ``COMMON_TOTAL`` a mark) and writes the rest as byte planes, one row a bucket of values. So a hot value
costs each task some rows at most, and no value is a row of its own. Records are numbered in the order in which they are stored,
so those of a chunk are a few runs of numbers, and only the bits of a value are kept that tell apart all values of the table.

Step 3 is the only one that may miss a link: two records just at the threshold whose edits are spread as evenly as
can be have no value in common with a probability of about 1e-4, far less elsewhere (measured recall: see the README).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release, stage
from .bitplanes import parities, planes_for, within

SKETCH, SKETCH_MOST, PART, LEAST_WIDTH = 24, 128, 12, 16
#: Letters of a window that common parts may cover.
COVERED = 4
MISS, CHANCE = 1e-4, 0.5
#: Share of the windows that a link must leave to both, in the worst case, if sketches are to find it.
LEAST_BOTH = 0.02
BANDS, ROWS = 64, 4
SHORT = 96
COMMON_LEAST = 256
#: A sketch value of more records than this joins none of them; all its records get bands.
COMMON_TOTAL = 512
#: Records of a value that are taken in pairs.
GROUP = 16
BLOCK = 1024
#: Sets marked at once, and pairs looked up at once, in the exact comparison.
TABLE, PAIRS = 32, 2048
#: Records whose values a task sorts together, and values a bucket is meant to hold.
CHUNK, BUCKET = 1 << 16, 1 << 21
#: Values of a record, for the size of a table of values; bits of a value beyond those that number all; runs of numbers a chunk may have.
MEAN, SPARE, RUNS = 80, 10, 64
PARTS, SLICES = 1 << 20, 64

GROUPS = "center bigint, id bigint, part int, sizes binary, ids binary"
PACKED = "id bigint, digest binary, packed binary, text string, n int"
CHUNKS = "bucket int, kind int, n int, tokens binary, ids binary"
SKETCHES, STARS, HOT = 0, 1, 2
ALL_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)

_CODE = np.full(256, 4, np.uint8)
_CODE[[ord(c) for c in "ACTG"]] = [0, 1, 2, 3]  # bits 1 and 2 of the letters
_FOUR = np.frombuffer(b"ACTG", np.uint8)[np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x if len(x) < 2 else x[np.concatenate([[True], x[1:] != x[:-1]])]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    return cp, np.cumsum(n) - n, n


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, digest, text) to PACKED: four letters a byte where a text has only A, C, G and T, else the text."""
    for b in batches:
        texts = b.column(2).to_pylist()
        if not texts:
            continue
        cp, first, n = _code_points(texts)
        code = np.where(cp < 256, _CODE[cp & 255], 4)
        plain = np.add.reduceat(code == 4, first) == 0
        size = np.where(plain, -(-n // 4), 0)
        start = np.cumsum(size) - size
        room = np.zeros(4 * int(size.sum()), np.uint8)
        where = np.repeat(4 * start - first, n) + np.arange(len(cp))
        own = np.repeat(plain, n)
        room[where[own]] = code[own]
        packed = np.packbits((room[:, None] >> np.array([1, 0], np.uint8) & 1).ravel())
        offsets = np.append(start, size.sum()).astype(np.int32)
        none = pa.py_buffer(np.packbits(plain, bitorder="little"))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.Array.from_buffers(pa.binary(), len(texts), [none, pa.py_buffer(offsets), pa.py_buffer(packed)]), pa.array([None if p else t for p, t in zip(plain, texts)], pa.string()), pa.array(n, pa.int32())],
            names=["id", "digest", "packed", "text", "n"],
        )


def _letters(packed: pa.Array, text: pa.Array, n: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of packed texts in one array, with the first place and the length of each; there may be others between them."""
    size = n.to_numpy(zero_copy_only=False).astype(np.int64)
    _, offsets, data = packed.buffers()
    at = np.frombuffer(offsets, np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    letters = _FOUR[np.frombuffer(data, np.uint8)[at[0] : at[-1]]].ravel() if at[-1] > at[0] else np.zeros(0, np.uint8)
    first = 4 * (at[:-1] - at[0])
    other = np.flatnonzero(packed.is_null().to_numpy(zero_copy_only=False))
    if len(other):
        cp, begin, _ = _code_points(text.take(pa.array(other)).to_pylist())
        first[other] = begin + len(letters)
        letters = np.concatenate([letters, cp])
    return letters, first, size


def _windows(cp: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit code of each window; equal windows have equal codes, whatever stands around them. Exact for 8 characters below 256."""
    exact = None
    if width == 8:
        b = np.concatenate([cp.astype(np.uint8), np.zeros(8, np.uint8)])
        exact = np.lib.stride_tricks.sliding_window_view(b, 8)[: len(cp)].copy().view(np.uint64).ravel()
        if not len(cp) or cp.dtype == np.uint8 or cp.max() < 256:
            return exact
    h = np.zeros(len(cp), np.uint64)
    padded = np.concatenate([cp.astype(np.uint64), np.zeros(width, np.uint64)])
    for i in range(width):
        h = (h ^ padded[i : i + len(cp)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    if exact is None:
        return h
    high = np.concatenate([[0], np.cumsum(cp > 255), np.full(width, np.count_nonzero(cp > 255))])
    return np.where(high[width : width + len(cp)] > high[: len(cp)], h, exact)


def _two_bits(cp: np.ndarray, *widths: int) -> list[np.ndarray]:
    """Codes of the windows of each width below 32, two bits a character: the bits in which A, C, G and T differ."""
    c = (cp >> 1 & 3).astype(np.uint32)
    later = lambda x, by: np.concatenate([x[by:], np.zeros(min(by, len(x)), x.dtype)]) if by else x
    out: list[np.ndarray | None] = [None for _ in widths]
    done, w = [0] * len(widths), 1
    while w < 32:
        for i, width in enumerate(widths):
            if width & w:
                part = later(c, done[i])
                if out[i] is not None and w + done[i] > 16:
                    out[i], part = out[i].astype(np.uint64), part.astype(np.uint64)
                out[i] = part if out[i] is None else (out[i] << out[i].dtype.type(2 * w)) | part
                done[i] += w
        if w < 16:  # 16 letters fill the 32 bits
            c = (c << np.uint32(2 * w)) | later(c, w)
        w *= 2
    return [x.astype(np.uint64) for x in out]


def _parts(codes: np.ndarray) -> np.ndarray:
    """The place below PARTS of each window of PART letters."""
    return (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).view(np.int64)


def _inside(letters: int, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the part that begins at a letter lies within one text."""
    step = np.zeros(letters + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + np.maximum(size - PART + 1, 0), -1)
    return np.cumsum(step[:-1]) > 0


def _count_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, counts) of all texts of a task: SLICES rows of counters; the last row holds the number of texts and of letters."""
    n, texts, letters = np.zeros(PARTS, np.int64), 0, 0
    for b in batches:
        if not len(b):
            continue
        cp, first, size = _letters(*b.columns)
        n += np.bincount(_parts(_two_bits(cp, PART)[0])[_inside(len(cp), first, size)], minlength=PARTS)
        texts, letters = texts + len(size), letters + int(size.sum())
    if texts:
        rows = [*n.reshape(SLICES, -1), np.array([texts, letters])]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES + 1), pa.int32()), pa.array([x.astype(np.int64).tobytes() for x in rows], pa.binary())], names=["slice", "counts"])


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counters of each slice; one slice is held at a time."""
    key, total = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "counts"])
    for b in batches:
        for k, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = np.frombuffer(counts, np.int64)
            if k == key:
                total = total + x
                continue
            if key is not None:
                yield row()
            key, total = k, x
    if key is not None:
        yield row()


def common_parts(reps: DataFrame) -> tuple[np.ndarray, int, int]:
    """Bits of the parts that are common in all ``reps``, their number and their letters. PARTS numbers reach the driver, whatever the input."""
    kind = "slice int, counts binary"
    counts = reps.select("packed", "text", "n").mapInArrow(_count_parts, kind).repartition("slice").sortWithinPartitions("slice").mapInArrow(_add_slices, kind)
    rows = {r["slice"]: np.frombuffer(r["counts"], np.int64) for r in counts.collect()}
    if not rows:
        return np.packbits(np.zeros(PARTS, bool)), 0, 0
    texts, letters = rows.pop(SLICES).tolist()
    n = np.concatenate([rows[i] for i in range(SLICES)])
    return np.packbits(n > max(COMMON_LEAST, 2 * letters / PARTS)), texts, letters


def window_width(letters: int) -> int:
    """Letters a window needs so that a record shares a sketch value with unrelated ones in less than CHANCE cases.

    The smallest of the hashes of n windows lie close together, so two records of n letters have SKETCH * n / 4**width in common by chance.
    """
    return min(max(LEAST_WIDTH, math.ceil(math.log(max(1, 1.5 * SKETCH * letters / CHANCE), 4))), 31)


def sketch_size(excluded: float, k: int, threshold: float, width: int) -> int:
    """The sketch values a record needs so that it shares one with a linked record but for a chance of MISS; 0 where no sketch does.

    The worst case: all of the excluded share is common to both, and edits are spread evenly over the rest.
    """
    kept = (2 * threshold / (1 + threshold) - excluded) / max(1 - excluded, 1e-9)
    both = min(1 - (1 - kept) * width / k, 1.0)
    if both < LEAST_BOTH:
        return 0
    similar = both / (2 - both)
    return SKETCH if similar > 0.99 else max(SKETCH, math.ceil(math.log(MISS) / math.log(1 - similar)))


_MULT = np.random.default_rng(20).integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bands(codes: np.ndarray) -> np.ndarray:
    """The bands of a set of codes."""
    codes, least = _mix(codes), np.full(BANDS * ROWS, ALL_ONES, np.uint64)
    for at in range(0, len(codes), 512):
        least = np.minimum(least, (codes[at : at + 512, None] * _MULT[None, :]).min(axis=0))
    band = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        band = (band ^ least[r::ROWS]) * np.uint64(0xC2B2AE3D27D4EB4F)
        band ^= band >> np.uint64(31)
    return _mix(band + np.arange(BANDS, dtype=np.uint64))


#: Bits of a sort key that number the texts of a piece; the rest is the hash of a window.
PIECE = 10


def _rows_of(first: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every window of each text."""
    m = np.maximum(n - width + 1, 0)
    row = np.repeat(np.arange(len(n)), m)
    return row, np.arange(len(row)) + np.repeat(first - (np.cumsum(m) - m), m)


def sketches(b: pa.RecordBatch, frequent: np.ndarray, width: int, k: int, sizes: list[int]) -> tuple[list[np.ndarray], list[np.ndarray | None]]:
    """The sketch of each text of (packed, text, n), and its bands where a sketch isn't enough."""
    tokens: list[np.ndarray] = []
    bands: list[np.ndarray | None] = []
    for at in range(0, len(b), 1 << PIECE):
        cp, first, n = _letters(*b.slice(at, 1 << PIECE).columns)
        part, h = _two_bits(cp, PART, width)
        often = np.concatenate([[False], frequent[_parts(part)] & _inside(len(cp), first, n), [False]])
        # a rare part that has its place of the table in common with a frequent one stands alone
        begun = np.concatenate([np.zeros(PART, np.int64), np.cumsum(often[1:-1] & (often[:-2] | often[2:]))])
        covered = np.concatenate([[0], np.cumsum(begun[PART:] > begun[:-PART]), np.zeros(width, np.int64)])
        common = covered[width : len(cp) + width] - covered[: len(cp)] > COVERED
        row, place = _rows_of(first, n, width)
        keep = ~common[place]
        excluded = np.bincount(row[~keep], minlength=len(n))
        # one sort for all texts: by text, then by hash; repeats count once, so they don't hide how much is left out
        key = _distinct(row[keep].astype(np.uint64) << np.uint64(64 - PIECE) | _mix(h[place[keep]] ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(PIECE))
        bounds = np.searchsorted(key, np.arange(len(n) + 1, dtype=np.uint64) << np.uint64(64 - PIECE)) if len(n) < 1 << PIECE else np.append(np.searchsorted(key, np.arange(len(n), dtype=np.uint64) << np.uint64(64 - PIECE)), len(key))
        own = np.diff(bounds)
        size = np.array(sizes)[-(-100 * excluded // np.maximum(1, excluded + own))]
        whole = (own >= SKETCH) & (2 * own >= np.maximum(n - width + 1, 0) - excluded)  # all windows are as good as any number of them
        enough = (size > 0) & ((own >= size) | whole) & (n - (k - 1) >= SHORT)
        key <<= np.uint64(PIECE)
        take = np.minimum(np.where(enough, size, SKETCH_MOST), own)
        tokens += [key[a : a + m] for a, m in zip(bounds.tolist(), take.tolist())]
        few = np.flatnonzero(~enough)
        small = _windows(cp, k) if len(few) else None
        banded = {int(i): _bands(_distinct(small[first[i] : first[i] + n[i] - k + 1])) for i in few}
        bands += [banded.get(i) for i in range(len(n))]
    return tokens, bands


def _planes(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, the highest first; upper planes that are empty are left out."""
    planes = x.astype(">u8").view(np.uint8).reshape(-1, 8).T
    used = (int(x.max(initial=0)).bit_length() + 7) // 8
    return np.ascontiguousarray(planes[8 - used :]).tobytes()


def _of_planes(data: bytes, n: int) -> np.ndarray:
    used = len(data) // n if n else 0
    eight = np.zeros((n, 8), np.uint8)
    eight[:, 8 - used :] = np.frombuffer(data, np.uint8).reshape(used, n).T
    return eight.view(">u8").ravel().astype(np.uint64)


def _runs(ids: np.ndarray) -> np.ndarray:
    """(first number, numbers before) of the runs of consecutive numbers in ``ids``; one run from the smallest where there would be more than RUNS."""
    own = _distinct(ids)
    new = np.flatnonzero(np.concatenate([[True], np.diff(own) != 1]))
    if len(new) > RUNS:
        new = new[:1]
    return np.stack([own[new], new])


def _by_runs(i: np.ndarray, runs: np.ndarray) -> bytes:
    at = np.searchsorted(runs[0], i, "right") - 1
    return runs.shape[1].to_bytes(8, "little") + runs.tobytes() + _planes((i - runs[0][at] + runs[1][at]).view(np.uint64))


def _of_runs(data: bytes, n: int) -> np.ndarray:
    k = int.from_bytes(data[:8], "little")
    first, before = np.frombuffer(data, np.int64, 2 * k, 8).reshape(2, k)
    rank = _of_planes(data[8 + 16 * k :], n).view(np.int64)
    at = np.searchsorted(before, rank, "right") - 1
    return rank - before[at] + first[at]


class _Chunks:
    """Collects values of records and gives them as rows of CHUNKS."""

    def __init__(self, buckets: int, bits: int) -> None:
        self.buckets, self.shift, self.rows = buckets, np.uint64(64 - bits), 0
        self.values: dict[int, list] = {SKETCHES: [], STARS: []}
        self.own: list[np.ndarray] = []

    def add(self, kind: int, tokens: np.ndarray, ids: np.ndarray) -> None:
        self.values[kind].append((tokens, ids))

    def flush(self) -> pa.RecordBatch | None:
        out: list[tuple] = []
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.runs = _runs(np.concatenate(self.own)) if self.own else None
        for kind, values in self.values.items():
            if not values:
                continue
            t, i = (np.concatenate(x) for x in zip(*values))
            t = t * np.uint64(0x9E3779B97F4A7C15)  # the values of sketches are small numbers; buckets are cut by the first bits
            order = np.lexsort((i, t)) if kind == STARS else np.argsort(t)
            t, i = t[order], i[order]
            new = np.concatenate([[True], t[1:] != t[:-1]])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(t)))
            if kind == STARS:
                edges.append((np.repeat(i[start], size)[~new], i[~new]))
                t, i = t[start], i[start]
            elif (size > COMMON_TOTAL).any():
                hot = np.repeat(size > COMMON_TOTAL, size)
                often = np.unique(i[hot])
                edges.append((np.full(len(often), -1), often))
                out += self._cut(HOT, t[hot & new], i[hot & new])
                t, i = t[~hot], i[~hot]
            out += self._cut(kind, t, i)
        self.values, self.own, self.rows = {SKETCHES: [], STARS: []}, [], 0
        for a, b in edges:
            for at in range(0, len(a), BUCKET):
                out.append((int(b[at] % self.buckets), -1, len(a[at : at + BUCKET]), a[at : at + BUCKET].astype(np.int64).tobytes(), b[at : at + BUCKET].astype(np.int64).tobytes()))
        if not out:
            return None
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())], names=["bucket", "kind", "n", "tokens", "ids"])

    def _cut(self, kind: int, t: np.ndarray, i: np.ndarray) -> list[tuple]:
        bucket = (t >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)
        bounds = [*np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(t)] if len(t) else []
        out = []
        for a, b in zip(bounds, bounds[1:]):
            # steps between sorted values are small, so their upper bytes compress; the last bits of a value aren't kept
            short = t[a:b] >> self.shift
            out.append((int(bucket[a]), kind, int(b - a), short[:1].tobytes() + _planes(np.diff(short, prepend=short[:1])), _by_runs(i[a:b], self.runs)))
        return out


def _values(common_bits: np.ndarray, width: int, k: int, threshold: float, buckets: int, bits: int, all_bands: bool):
    """(id, packed, text, n) to CHUNKS: sketches, and bands of records that need them, or only bands of all."""
    sizes = [sketch_size(x / 100, k, threshold, width) for x in range(101)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, chunks = np.unpackbits(common_bits).astype(bool), _Chunks(buckets, bits)
        for b in batches:
            if not len(b):
                continue
            ids = b.column(0).to_numpy()
            if chunks.rows and chunks.rows + len(ids) > CHUNK and (out := chunks.flush()):
                yield out
            texts = pa.RecordBatch.from_arrays(b.columns[1:], names=["packed", "text", "n"])
            if all_bands:
                cp, first, n = _letters(*texts.columns)
                small = _windows(cp, k)
                bands = [_bands(_distinct(small[a : a + m - k + 1])) for a, m in zip(first, n)]
            else:
                tokens, bands = sketches(texts, frequent, width, k, sizes)
                chunks.add(SKETCHES, np.concatenate(tokens), np.repeat(ids, [len(t) for t in tokens]))
            banded = [x is not None for x in bands]
            if any(banded):
                chunks.add(STARS, np.concatenate([x for x in bands if x is not None]), np.repeat(ids[banded], BANDS))
            chunks.own.append(ids)
            chunks.rows += len(ids)
        if out := chunks.flush():
            yield out

    return run


def _forest(edges: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(center, id): each id of ``edges`` once with the smallest id it is connected to; edges of -1 stay as they are."""
    a, b = (np.concatenate(x) for x in zip(*edges))
    often = np.unique(b[a < 0])
    a, b = a[a >= 0], b[a >= 0]
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        while (label != label[label]).any():
            label = label[label]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    center, ids = np.concatenate([nodes[label[moved]], np.full(len(often), -1)]), np.concatenate([nodes[moved], often])
    for at in range(0, len(ids), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(center[at : at + (1 << 16)], pa.int64()), pa.array(ids[at : at + (1 << 16)], pa.int64())], names=["center", "id"])


#: Edges that a task of ``components`` takes.
FOREST = 1 << 22


def _edges(center: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(ids))
    return pa.RecordBatch.from_arrays([pa.array(center, pa.int64()), pa.array(ids, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.binary())], names=["center", "id", "part", "sizes", "ids"])


def _stars(most: int, parts: int):
    """Rows of CHUNKS, sorted by bucket and falling kind, to GROUPS.

    A row has an edge (center, id); the center is the smallest id of a value, or -1 where the value is too common. Or it has the
    ids of many values, each in 2 to GROUP records; the smallest decides the part.
    """
    of_part = lambda x: (_mix(x.view(np.uint64)) % np.uint64(parts)).view(np.int64)

    def close(kind: int, t: np.ndarray, i: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        order = np.argsort(t, kind="stable")
        t, i = t[order], i[order]
        start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.diff(np.append(start, len(t)))
        center = np.minimum.reduceat(i, start)
        if kind != SKETCHES:
            return np.repeat(center, size), i, []
        center = np.where((size > most) | np.isin(t[start], hot), -1, center)
        few = (center >= 0) & (size > 1) & (size <= GROUP)
        whole = np.repeat(~few, size)
        which = np.flatnonzero(few)
        which = which[np.lexsort((center[which], of_part(center[which])))]
        part, n = of_part(center[which]), size[which]
        first = np.cumsum(n) - n
        members = i[np.repeat(start[which] - first, n) + np.arange(n.sum())]
        cut = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else [], len(part)).astype(int)
        ends = np.append(first, len(members))
        groups = []
        for a, b in zip(cut, cut[1:]):
            own = members[ends[a] : ends[b]]
            low = int(own.min())
            groups.append((int(part[a]), n[a:b].astype(np.uint8).tobytes(), low.to_bytes(8, "little", signed=True) + _planes((own - low).view(np.uint64))))
        return np.repeat(center, size)[whole], i[whole], groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, hot = None, [], np.zeros(0, np.uint64)
        edges: list[tuple[np.ndarray, np.ndarray]] = []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                a, b, groups = close(key[1], np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), hot)
                edges.append((a[a != b], b[a != b]))
                if groups:
                    none = pa.nulls(len(groups), pa.int64())
                    part, sizes, ids = zip(*groups)
                    yield pa.RecordBatch.from_arrays([none, none, pa.array(part, pa.int32()), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], names=["center", "id", "part", "sizes", "ids"])

        for b in batches:
            for bucket, kind, n, tokens, ids in zip(*(c.to_pylist() for c in b.columns)):
                if kind < 0:
                    edges.append((np.frombuffer(tokens, np.int64), np.frombuffer(ids, np.int64)))
                else:
                    if key != (bucket, kind):
                        yield from done()
                        hot = hot if key and key[0] == bucket else np.zeros(0, np.uint64)
                        key, held = (bucket, kind), []
                    t = np.cumsum(_of_planes(tokens[8:], n)) + np.frombuffer(tokens, np.uint64, 1)
                    if kind == HOT:
                        hot = np.append(hot, t)
                    else:
                        held.append((t, _of_runs(ids, n)))
                if sum(len(a) for a, _ in edges) > 8 * BUCKET:
                    yield from (_edges(*x.columns) for x in _forest(edges))
                    edges.clear()
        yield from done()
        if edges:
            yield from (_edges(*x.columns) for x in _forest(edges))

    return run


def _groups(chunks: DataFrame, partitions: int) -> DataFrame:
    return chunks.repartitionById(partitions, F.col("bucket") % partitions).sortWithinPartitions("bucket", F.desc("kind")).mapInArrow(_stars(COMMON_TOTAL, partitions), GROUPS)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, sizes, ids) of groups, sorted by part, to (a, b, sure): edges of records that share two values or more, as few as connect them, and pairs of one shared value that those don't connect."""

    def of(sizes: list[np.ndarray], ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        size, (nodes, i) = np.concatenate(sizes), np.unique(np.concatenate(ids), return_inverse=True)
        start = np.cumsum(size) - size
        keys = []
        for m in np.unique(size).tolist():
            own = np.sort(i[start[size == m][:, None] + np.arange(m)].astype(np.uint64), axis=1)
            x, y = np.triu_indices(m, 1)
            keys.append((own[:, x] << np.uint64(32) | own[:, y]).ravel())
        key = np.sort(np.concatenate(keys))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n, key = np.diff(np.append(first, len(key))), key[first]
        a, b = (key >> np.uint64(32)).view(np.int64), (key & np.uint64(0xFFFFFFFF)).view(np.int64)
        label = np.arange(len(nodes))
        if (n > 1).any():
            for x in _forest([(a[n > 1], b[n > 1])]):
                center, node = x.column(0).to_numpy(), x.column(1).to_numpy()
                label[node] = center
                yield row(nodes[center], nodes[node], True)
        apart = (n == 1) & (label[a] != label[b])
        yield row(nodes[a[apart]], nodes[b[apart]], False)

    def row(a: np.ndarray, b: np.ndarray, sure: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), sure), pa.bool_())], names=["a", "b", "sure"])

    key, sizes, ids = None, [], []
    for batch in batches:
        for part, size, data in zip(*(c.to_pylist() for c in batch.columns)):
            if sizes and part != key:
                yield from of(sizes, ids)
                sizes, ids = [], []
            key = part
            sizes.append(np.frombuffer(size, np.uint8).astype(np.int64))
            ids.append(_of_planes(data[8:], int(sizes[-1].sum())).view(np.int64) + int.from_bytes(data[:8], "little", signed=True))
    if sizes:
        yield from of(sizes, ids)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task, as few as connect the same ids; no more than 2 * FOREST are held at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        if sum(len(a) for a, _ in held) > 2 * FOREST:
            less = list(_forest(held))
            held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in less]
            if sum(len(a) for a, _ in held) > FOREST:
                yield from less
                held = []
    if held:
        yield from _forest(held)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of ``edges`` (a, b), which aren't negative; the component is its smallest id.

    Tasks of FOREST edges or so first keep what connects their ids. What they leave is contracted to the smallest neighbour; each
    round writes its edges, and they at least halve the nodes of a component that is left. If all edges are no more than one
    such task takes, nothing is left to contract.
    """
    first = stage(edges.where("a <> b").distinct(), "edges")
    tasks = -(-first.count() // FOREST)
    if not tasks:
        return edges.sparkSession.createDataFrame([], "id bigint, component bigint")
    left = stage(first.repartition(tasks, "a").mapInArrow(_forests, "a bigint, b bigint"), "edges")
    release(first)
    if tasks == 1:
        whole = left.select(F.col("b").alias("id"), F.col("a").alias("component"))
        return whole.union(left.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
    labels: DataFrame | None = None
    parents = []
    while left.head(1):
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "parents")
        parents.append(parent)
        before = left
        pa_, pb = parent.withColumnsRenamed({"p": "pa"}), parent.withColumnsRenamed({"a": "b", "p": "pb"})
        left = stage(left.join(pa_, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        release(before)
        if labels is None:
            labels = parent.select(F.col("a").alias("id"), F.col("p").alias("component"))
        else:
            labels = labels.join(parent.withColumnRenamed("a", "component"), "component", "left").select("id", F.coalesce("p", "component").alias("component"))
    out = stage(labels, "components")
    release(left, *parents)
    return out


def _numbers(cp: np.ndarray, first: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, number) of the distinct substrings of each text, sorted, and a bound of the numbers.

    Equal substrings have equal numbers: those of A, C, G and T their two-bit code if k is at most 8, others the next numbers.
    """
    row, place = _rows_of(first, n, k)
    if k <= 8:
        plain = np.concatenate([[0], np.cumsum(_CODE[cp & 255] + 4 * (cp > 255) > 3 if cp.dtype != np.uint8 else _CODE[cp] > 3), np.zeros(k, np.int64)])
        other = plain[place + k] > plain[place]
        number, bound = _two_bits(cp, k)[0][place], 1 << 2 * k
        if other.any():
            codes, at = np.unique(_windows(cp, k)[place[other]], return_inverse=True)
            number[other] = at.astype(np.uint64) + np.uint64(bound)
            bound += len(codes)
    else:
        codes, at = np.unique(_windows(cp, k)[place], return_inverse=True)
        number, bound = at.astype(np.uint64), len(codes)
    key = _distinct(row.astype(np.uint64) << np.uint64(40) | number)
    return (key >> np.uint64(40)).view(np.int64), (key & np.uint64((1 << 40) - 1)).view(np.int64), bound


def _compare(k: int, threshold: float):
    """Rows come sorted by (component, i, j); small components share blocks."""

    def flush(keys: np.ndarray, texts: pa.Table) -> pa.RecordBatch | None:
        n = len(texts)
        half, number = keys[3], keys[4]
        cross = keys[1] != keys[2]
        group = np.concatenate([[0], np.cumsum((keys[:3, 1:] != keys[:3, :-1]).any(axis=0))])
        out_a, out_b = [], []
        for r in range(0, n, BLOCK):
            stop = min(n, r + BLOCK)
            end = min(n, int(np.searchsorted(group, group[stop - 1], "right")))
            rows, cols = slice(r, stop), slice(r, end)
            (block,) = texts.slice(r, end - r).combine_chunks().to_batches(max_chunksize=end - r)
            row, code, bound = _numbers(*_letters(*block.columns), k)
            count = np.bincount(row, minlength=end - r)
            start = np.cumsum(count) - count
            bits = parities(row, code, end - r, planes_for(count))
            wanted = (group[rows, None] == group[None, cols]) & (np.arange(r, stop)[:, None] < np.arange(r, end)[None, :])
            wanted &= ~cross[rows, None] | (half[rows, None] != half[None, cols])
            x, y = within(bits[: stop - r], bits, wanted, count[: stop - r], count, (1 - threshold) / (1 + threshold))
            real = y < end - r
            x, y = x[real], y[real]
            shared = _shared(x, y, code, start, count, bound)
            near = shared >= threshold * (count[x] + count[y] - shared) - 1e-9
            a, b = number[r + x[near]], number[r + y[near]]
            out_a.append(np.minimum(a, b))
            out_b.append(np.maximum(a, b))
        out_a, out_b = np.concatenate(out_a), np.concatenate(out_b)
        return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"]) if len(out_a) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = np.zeros((5, 0), np.int64), []
        for b in batches:
            if not len(b):
                continue
            keys = np.concatenate([keys, np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(5)])], axis=1)
            held.append(b.select(["packed", "text", "n"]))
            if keys.shape[1] >= 4 * BLOCK:
                # all rows but those of the last group, which may go on in the next batch
                cut = int(np.flatnonzero((keys[:3] != keys[:3, -1:]).any(axis=0)).max(initial=-1)) + 1
                if cut:
                    texts = pa.Table.from_batches(held)
                    if out := flush(keys[:, :cut], texts.slice(0, cut)):
                        yield out
                    keys, held = keys[:, cut:], texts.slice(cut).to_batches()
        if keys.shape[1] and (out := flush(keys, pa.Table.from_batches(held))):
            yield out

    return run


def _shared(x: np.ndarray, y: np.ndarray, code: np.ndarray, start: np.ndarray, count: np.ndarray, bound: int) -> np.ndarray:
    """The numbers that the sets of each pair have in common, exactly; TABLE sets at a time are marked in a table."""
    out = np.zeros(len(x), np.int64)
    order = np.argsort(x, kind="stable")
    sets, first = np.unique(x[order], return_index=True)
    first = np.append(first, len(x))
    has = np.zeros((TABLE, bound), bool)

    def of(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = count[which]
        return np.repeat(np.arange(len(which)), n), np.arange(n.sum()) + np.repeat(start[which] - (np.cumsum(n) - n), n)

    for at in range(0, len(sets), TABLE):
        own = sets[at : at + TABLE]
        row, place = of(own)
        has[row, code[place]] = True
        pairs = order[first[at] : first[min(len(sets), at + TABLE)]]
        for part in np.split(pairs, range(PAIRS, len(pairs), PAIRS)):
            item, where = of(y[part])
            hit = has[np.searchsorted(own, x[part])[item], code[where]]
            out[part] = np.bincount(item[hit], minlength=len(part))
        has[row, code[place]] = False
    return out


def _verify(k: int, threshold: float):
    """(a, b, texts of a, texts of b) to the pairs (a, b) that are linked, a < b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), PAIRS):
                b = whole.slice(at, PAIRS)
                m = len(b)
                both = [pa.concat_arrays([b.column(2 + c), b.column(5 + c)]) for c in range(3)]
                row, code, _ = _numbers(*_letters(*both), k)
                count = np.bincount(row, minlength=2 * m)
                key = np.sort((row % m).astype(np.uint64) << np.uint64(40) | code.view(np.uint64))
                shared = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(40)).view(np.int64), minlength=m)
                near = shared >= threshold * (count[:m] + count[m:] - shared) - 1e-9
                x, y = b.column(0).to_numpy()[near], b.column(1).to_numpy()[near]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run


def near_copies(df: DataFrame, id_col: str, text_col: str, k: int = 8, threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(links, copies): links (a, b, a < b) between representatives, copies (id, rep) of exact copies but their representative.

    Texts are compared in upper case. A null text or one shorter than ``k`` takes no part; ids are
    unique bigints that aren't negative, rows with a null id are left out. Other columns don't matter; an empty table gives no links.
    """
    spark = df.sparkSession
    text = F.upper(F.col(text_col))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("digest"), text.alias("text")).where(F.length("text") >= k)
    one = rows.mapInArrow(_pack, PACKED).groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("packed", "text", "n")).alias("t"))
    reps = stage(one.select(F.monotonically_increasing_id().alias("num"), "id", F.when(F.col("copies") > 1, F.col("digest")).alias("digest"), "t.*"), "texts")
    classes = reps.where("digest IS NOT NULL").select("digest", F.col("id").alias("rep"))
    copies = stage(rows.select("id", "digest").join(classes, "digest").where("id <> rep").select("id", "rep"), "copies")

    texts = reps.select("num", "packed", "text", "n")
    common, number, letters = common_parts(reps)
    width = window_width(letters)
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(shuffled, -(-number * MEAN // BUCKET))
    bits = min(56, (max(1, number) * MEAN).bit_length() + SPARE)
    values = lambda of, all_bands: of.mapInArrow(_values(common, width, k, threshold, partitions, bits, all_bands), CHUNKS)
    groups = stage(_groups(values(texts, False), partitions), "groups")
    pairs = stage(groups.where("part IS NOT NULL").select("part", "sizes", "ids").repartitionById(partitions, "part").sortWithinPartitions("part").mapInArrow(_pairs, "a bigint, b bigint, sure boolean"), "pairs")
    edges = groups.where("center <> -1").select(F.col("center").alias("a"), F.col("id").alias("b")).union(pairs.where("sure").select("a", "b"))
    if groups.where("center = -1").head(1):
        # two records that share a value too common for a star both hold it, so both get bands
        often = texts.join(groups.where("center = -1").select(F.col("id").alias("num")).distinct(), "num", "left_semi")
        edges = edges.union(_groups(values(often, True), partitions).select(F.col("center").alias("a"), F.col("id").alias("b")))
    member = components(edges)
    release(groups)
    size = member.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / F.lit(2 * BLOCK)).cast("int")
    placed = member.withColumnRenamed("id", "num").join(size, "component").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("num"), F.col("blocks").cast("bigint")).cast("int"))
    placed = placed.select("num", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("num", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    full = placed.join(reps, "num").select("component", "i", "j", "own", "id", "packed", "text", "n")
    links = full.repartition(max(shuffled, number // (32 * BLOCK)), "component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(_compare(k, threshold), "a bigint, b bigint")

    single = pairs.where("NOT sure").select("a", "b").distinct()
    for c in "ab":
        single = single.join(member.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}")), c, "left")
    single = single.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    for c in "ab":
        single = single.join(reps.select(F.col("num").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("id", "packed", "text", "n"))), c)
    alone = single.select("id_a", "id_b", *(f"{x}_{c}" for c in "ab" for x in ("packed", "text", "n"))).mapInArrow(_verify(k, threshold), "a bigint, b bigint")
    links = links.union(alone)
    return links, copies


def near_pairs(df: DataFrame, id_col: str, text_col: str, k: int = 8, threshold: float = 0.6) -> DataFrame:
    """(<id>_a, <id>_b) of all linked rows, exact copies included.

    The result lists every pair, so it grows with the square of a group of copies; ``near_classes`` doesn't. Large groups are cut
    into blocks, and each pair of blocks of a group is a key of its own, so none is joined in one task.
    """
    links, copies = near_copies(df, id_col, text_col, k, threshold)
    m = stage(copies.select("rep", "id").union(copies.select("rep", F.col("rep").alias("id")).distinct()), "members")
    left, right = m.select(F.col("rep").alias("a"), F.col("id").alias("x")), m.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    # links go from class to class; a text without copies is its own only member
    between = links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    blocks = m.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    cut = m.join(blocks, "rep").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks").cast("bigint")).cast("int"))
    one = cut.select("rep", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), F.col("id").alias("x"))
    other = cut.select("rep", F.col("own").alias("j"), F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("id").alias("y"))
    same = one.join(other, ["rep", "i", "j"]).where("i < j OR x < y").select("x", "y")
    return between.union(same).select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b"))


def near_classes(df: DataFrame, id_col: str, text_col: str, k: int = 8, threshold: float = 0.6) -> DataFrame:
    """(id, class_id, n_links) of each row that takes part: the smallest id its links lead to, and its number of links to other texts."""
    links, copies = near_copies(df, id_col, text_col, k, threshold)
    links = stage(links, "links")
    rows = df.where(F.col(id_col).isNotNull() & (F.length(F.upper(F.col(text_col))) >= k)).select(F.col(id_col).cast("bigint").alias("id"))
    named = components(links)
    n = links.select("a").union(links.select("b")).groupBy("a").agg(F.count(F.lit(1)).alias("n_links")).withColumnRenamed("a", "rep")
    full = rows.join(copies, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    return full.join(named.withColumnRenamed("id", "rep"), "rep", "left").join(n, "rep", "left").select(F.col("id").alias(id_col), F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
