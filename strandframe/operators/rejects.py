"""Undecoded lines of delimited files: valid rows as records, the others with a reason.

A batch of lines is one array of code points. Quotes are a mask; their running count modulo
two tells which delimiters stand outside quotes, so fields and record ends of all lines come
from a few array operations. Count and type checks on the field bounds give the reason.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTE, RETURN = ord('"'), "\r"
#: Letters of a sequence, and the lowest quality code of each format.
SEQ_LETTERS = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv-."
LOWEST_CODE = {"sanger": 33, "illumina": 64, "solexa": 59}
HIGHEST_CODE = 126

SEQ_OK = np.zeros(129, bool)
SEQ_OK[[ord(c) for c in SEQ_LETTERS]] = True

OUT = "line_no bigint, layout_id int, reason string, id string, descr string, seq string, qual string"
OUT_ARROW = pa.schema([("line_no", pa.int64()), ("layout_id", pa.int32()), *((c, pa.string()) for c in ("reason", "id", "descr", "seq", "qual"))])


def parse_lines(lines: list[str | None], delim: list[str | None], n_cols, seq_col, qual_col, lowest) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each line, reason codes, first field of each line, field starts, field ends).

    Reasons: 0 none, 1 quoting, 2 columns, 3 seq, 4 qual, 5 layout. Starts and ends are positions in
    the joined text, where each line is followed by one character. Columns of -1 stand for none.
    """
    n = len(lines)
    text = ["" if x is None else x[:-1] if x.endswith(RETURN) else x for x in lines]
    cp = np.frombuffer("".join(t + "\n" for t in text).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.fromiter(map(len, text), np.int64, n)
    line_end = np.cumsum(length + 1) - 1
    line_start = line_end - length
    row = np.repeat(np.arange(n), length + 1)
    quote = cp == QUOTE
    quote[line_end] = False
    seen = np.concatenate([[0], np.cumsum(quote)])  # seen[p]: quotes before p
    odd = ((seen[:-1] - seen[line_start][row]) & 1).astype(bool)
    code = np.fromiter((ord(d) if d else 0x110000 for d in delim), np.uint32, n)
    ends = (cp == code[row]) & ~odd
    ends[line_end] = True
    starts = np.concatenate([[True], ends[:-1]])
    # a quote outside quotes must begin its field or double the quote before it; one inside
    # must end its field or be doubled by the next
    before = np.concatenate([[False], quote[:-1]])
    after = np.concatenate([quote[1:], [False]])
    closes = np.concatenate([ends[1:], [False]])
    wrong = quote & np.where(odd, ~closes & ~after, ~starts & ~before)
    bad_quotes = odd[line_end].copy()
    bad_quotes[row[wrong]] = True

    fs, fe = np.flatnonzero(starts), np.flatnonzero(ends)
    n_fields = np.bincount(row[fe], minlength=n)
    first = np.cumsum(n_fields) - n_fields
    reason = np.zeros(n, np.int8)

    def field(col: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        has = (col >= 0) & (col < n_fields)
        k = np.where(has, first + col, 0)
        s, e = np.where(has, fs[k], 0), np.where(has, fe[k], 0)
        quoted = has & (e > s) & quote[s]
        return s + quoted, np.where(quoted, np.maximum(e - 1, s + 1), e), quoted

    ss, se, _ = field(seq_col)
    bad_letter = np.concatenate([[0], np.cumsum(~SEQ_OK[np.minimum(cp, 128)])])
    bad_seq = (se <= ss) | (bad_letter[np.maximum(se, ss)] > bad_letter[ss])
    qs, qe, q_quoted = field(qual_col)
    bad_code = np.concatenate([[0], np.cumsum((cp < lowest[row]) | (cp > HIGHEST_CODE))])
    doubled = np.where(q_quoted, (seen[qe] - seen[qs]) // 2, 0)
    q_len = qe - qs - doubled
    bad_qual = (qual_col >= 0) & (q_len > 0) & ((q_len != se - ss) | (bad_code[np.maximum(qe, qs)] > bad_code[qs]))
    for code_, bad in ((4, bad_qual), (3, bad_seq), (2, n_fields != n_cols), (1, bad_quotes), (5, n_cols < 0)):
        reason[bad] = code_
    return text, reason, first, fs, fe


def cut_quoted(lines: list[str], delim: str) -> list[list[str]]:
    """The fields of each line, unquoted; delimiters and line feeds within quotes are content. Wrong quoting is an error."""
    n = len(lines)
    none = np.full(n, -1)
    text, reason, first, fs, fe = parse_lines(lines, [delim] * n, np.zeros(n, np.int64), none, none, np.zeros(n, np.uint32))
    if (reason == 1).any():
        raise ValueError(f"wrong quotes: {lines[int(np.flatnonzero(reason == 1)[0])][:80]!r}")
    joined = "".join(t + "\n" for t in text)
    cells = [v[1:-1].replace('""', '"') if (v := joined[a:b])[:1] == '"' else v for a, b in zip(fs.tolist(), fe.tolist())]
    bounds = [*first.tolist(), len(cells)]
    return [cells[a:b] for a, b in zip(bounds, bounds[1:])]


REASONS = [None, "quoting", "columns", "seq", "qual", "layout"]


def _fields(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray, has: np.ndarray) -> pa.Array:
    """The text of one field of each line that has it, unquoted; null for the others."""
    k = np.where(has, which, 0)
    s, e = np.where(has, starts[k], 0), np.where(has, ends[k], 0)
    quoted = has & (e > s) & (cp[s] == QUOTE)
    s, n = s + quoted, e - s - 2 * quoted
    row = np.repeat(np.arange(len(n)), n)
    letters = cp[np.arange(len(row)) + np.repeat(s - (np.cumsum(n) - n), n)]
    # within quotes they come in pairs, of which one stays
    pair = (letters == QUOTE) & quoted[row]
    if pair.any():
        keep = ~pair | (np.cumsum(pair) % 2 == 1)
        letters, row = letters[keep], row[keep]
    width = 1 + (letters >= 0x80).astype(np.int64) + (letters >= 0x800) + (letters >= 0x10000)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, width, len(n)))]).astype(np.int32)
    data = letters.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(data), pa.py_buffer(np.packbits(has, bitorder="little")))


def _split(with_records: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {f: b.column(i) for i, f in enumerate(b.schema.names)}
            n = b.num_rows
            if not n:
                continue
            num = lambda f: c[f].fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            lowest = np.array([LOWEST_CODE.get(f, LOWEST_CODE["sanger"]) for f in c["qual_fmt"].to_pylist()], np.uint32)
            text, reason, first, fs, fe = parse_lines(c["raw_line"].to_pylist(), c["delim"].to_pylist(), num("n_cols"), num("seq_col"), num("qual_col"), lowest)
            out = {f: pa.nulls(n, pa.string()) for f in ("id", "descr", "seq", "qual")}
            if with_records:
                cp = np.frombuffer("".join(t + "\n" for t in text).encode("utf-32-le", "surrogatepass"), np.uint32)
                n_fields = np.diff(np.append(first, len(fs)))
                for f, col in (("id", num("id_col")), ("descr", num("desc_col")), ("seq", num("seq_col")), ("qual", num("qual_col"))):
                    out[f] = _fields(cp, fs, fe, first + col, (reason == 0) & (col >= 0) & (col < n_fields))
            yield pa.RecordBatch.from_arrays([c["line_no"].cast(pa.int64()), c["layout_id"].cast(pa.int32()), pa.array([REASONS[r] for r in reason], pa.string()), *out.values()], schema=OUT_ARROW)

    return run


def read_lines(lines: DataFrame, layouts: DataFrame, with_records: bool = True) -> DataFrame:
    """Each line of ``lines`` (line_no, layout_id, raw_line) with its ``reason`` or its record.

    Reasons, the first that holds: ``layout`` (null or unknown layout), ``quoting``, ``columns``,
    ``seq``, ``qual``. A null line reads as an empty one. Fields of rejected lines are null, an
    empty field is ''. ``layouts`` has one row per layout_id; other columns are ignored.
    """
    joined = lines.select("line_no", "layout_id", "raw_line").join(layouts.select("layout_id", "delim", "n_cols", "id_col", "desc_col", "seq_col", "qual_col", "qual_fmt"), "layout_id", "left")
    cols = ("line_no", "layout_id", "raw_line", "delim", "n_cols", "id_col", "desc_col", "seq_col", "qual_col", "qual_fmt")
    return joined.select(*cols).mapInArrow(_split(with_records), OUT)


def rejects(lines: DataFrame, layouts: DataFrame) -> DataFrame:
    """(line_no, reason) of each line that fails."""
    return read_lines(lines, layouts, with_records=False).where("reason IS NOT NULL").select("line_no", "reason")


def records(lines: DataFrame, layouts: DataFrame) -> DataFrame:
    """The valid lines as records."""
    return read_lines(lines, layouts).where("reason IS NULL").drop("reason")
