from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from strandframe.operators import rejects, units


def by_hand(line, delim, n_cols, seq_col, qual_col, low):
    """A character-by-character reading of one line."""
    line = line[:-1] if line.endswith("\r") else line
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            i, text = i + 1, ""
            while True:
                if i >= len(line):
                    return "quoting"
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        text, i = text + '"', i + 2
                        continue
                    i += 1
                    break
                text, i = text + line[i], i + 1
            if i < len(line) and line[i] != delim:
                return "quoting"
        else:
            j = line.find(delim, i)
            j = len(line) if j < 0 else j
            text, i = line[i:j], j
            if '"' in text:
                # quoting errors come before all others, wherever they stand
                return "quoting"
        fields.append(text)
        if i >= len(line):
            break
        i += 1
    if len(fields) != n_cols:
        return "columns"
    seq = fields[seq_col]
    if not seq or set(seq) - set(rejects.SEQ_LETTERS):
        return "seq"
    if qual_col >= 0 and fields[qual_col] and (len(fields[qual_col]) != len(seq) or any(not low <= ord(c) <= 126 for c in fields[qual_col])):
        return "qual"
    return None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='",AC\rN\n @é', max_size=14), min_size=1, max_size=12))
def test_lines_against_reading_by_hand(lines):
    n = len(lines)
    full = lambda v: np.full(n, v)
    _, reason, *_ = rejects.parse_lines(lines, [","] * n, full(2), full(0), full(1), np.full(n, 64, np.uint32))
    assert [rejects.REASONS[r] for r in reason] == [by_hand(x, ",", 2, 0, 1, 64) for x in lines]


def test_read_lines_odd_cases(spark):
    layouts = spark.createDataFrame([(1, ",", 3, 0, None, 1, 2, "sanger"), (2, "é", 1, 0, None, 0, None, None)], "layout_id int, delim string, n_cols int, id_col int, desc_col int, seq_col int, qual_col int, qual_fmt string")
    lines = spark.createDataFrame([(1, 1, 'a,AC,"I"""\r', "x"), (2, 1, None, "x"), (3, None, "a", "x"), (4, 9, "a", "x"), (5, 2, "ACéA", "x"), (6, 1, "b,AC,", "x"), (7, 1, "c," + "A" * 200_000 + ",", "x")], "line_no bigint, layout_id int, raw_line string, reason string")
    got = {r["line_no"]: r for r in rejects.read_lines(lines, layouts).collect()}
    assert [got[i]["reason"] for i in range(1, 8)] == [None, "columns", "layout", "layout", "columns", None, None]
    assert (got[1]["qual"], got[6]["qual"], len(got[7]["seq"])) == ('I"', "", 200_000)
    assert rejects.rejects(lines.limit(0), layouts).collect() == []


def test_formats_named(spark):
    runs = spark.createDataFrame([("r1", "solexa"), ("r2", None)], "run_id string, qual_fmt string")
    rows = [
        (1, "r1", "sangar", None, "!#"), (2, "r1", None, "was Sanger, recoded to Illumina 1.3-1.7", "@B"), (3, "r1", None, "lot 64 opened", ";@"), (4, "r2", None, None, "!!"), (5, "r1", "what", "phred numbers", "1 2"),
        (6, None, "QUAL file", None, "30,  2\n1"), (7, "r1", "illumina 1.9", None, "+"), (8, "r1", "sanger", None, ""), (9, "r1", "sanger", None, None), (10, "r1", None, "from pipeline Illumina 1.5. repeat of plate 18", "A"),
        (11, "r1", None, "converted from Solexa, is Sanger now", "+"), (12, "zz", None, "bubbles at cycle 33", "+"),
    ]
    sets = spark.createDataFrame(rows, "set_no bigint, run_id string, orig_format string, remark string, scores string")
    got = {r["set_no"]: (r["orig_format"], r["phred_sum"]) for r in units.phred_sums(sets, runs).collect()}
    assert got == {1: ("sanger", 2), 2: ("illumina", 2), 3: ("solexa", 1 + 3), 6: ("phred", 33), 7: ("sanger", 10), 10: ("illumina", 1), 11: ("sanger", 10)}


def test_segments_are_exact():
    rng = np.random.default_rng(1)
    x, w = np.concatenate([rng.normal(0, 0.1, 9), rng.normal(2, 0.1, 7)]), np.ones(16)

    def cost(cuts):
        ends = [*cuts, 16]
        return sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(ends, ends[1:])) + 0.5 * (len(cuts) - 1)

    from itertools import combinations

    best = min(([0, *c] for k in range(4) for c in combinations(range(1, 16), k)), key=cost)
    assert units.segment(x, w, 0.5) == best == [0, 9]


def test_segments_of_long_histories():
    rng = np.random.default_rng(5)

    def cost_of_best(x, w, penalty):
        cw, cx, cxx = (np.concatenate([[0.0], np.cumsum(v)]) for v in (w, w * x, w * x * x))
        best = np.zeros(len(x) + 1)
        best[0] = -penalty
        for j in range(1, len(x) + 1):
            best[j] = (best[:j] + cxx[j] - cxx[:j] - (cx[j] - cx[:j]) ** 2 / (cw[j] - cw[:j])).min() + penalty
        return best[-1]

    for trial in range(40):
        n = int(rng.integers(1, 300))
        x = np.repeat(rng.normal(0, 2, n), rng.integers(1, 30, n))[:n] + rng.normal(0, trial % 3, n)
        w = rng.integers(1, 4, n).astype(float)
        cuts = [*units.segment(x, w, 4.0), n]
        got = -4.0 + sum(4.0 + float((w[a:b] * (x[a:b] - np.average(x[a:b], weights=w[a:b])) ** 2).sum()) for a, b in zip(cuts, cuts[1:]))
        assert got == pytest.approx(cost_of_best(x, w, 4.0), abs=1e-6)


def test_segments_shorter_than_a_span(spark):
    """A change of units over 6 of 3,000 rows of a run, and one to numbers."""
    begin = datetime(2024, 1, 1)
    text = lambda i: chr(64 + 30 + i % 2) * 8 if 1500 <= i < 1506 else "30 31 30" if i >= 2900 else chr(33 + 30 + i % 2) * 8
    rows = [("r", text(i), begin + timedelta(minutes=i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "run_id string, scores string, measured_at timestamp")
    got = sorted(units.level_segments(df).collect(), key=lambda r: r["segment"])
    assert [(r["n_sets"], r["matched"]) for r in got] == [(1500, None), (6, "33->64"), (1394, "64->33"), (100, "33->0")]
    assert got[1]["first_at"] == begin + timedelta(minutes=1500)


def test_rows_coded_otherwise_than_named(spark):
    """A stretch of a run whose codes can't be those of the named format is read with the other offset; rows in between that are named otherwise don't hide it."""
    begin, rng = datetime(2024, 1, 1), np.random.default_rng(2)
    text = lambda offset: "".join(chr(offset + int(x)) for x in rng.integers(24, 38, 20))
    rows = []
    for i in range(900):
        name = "sanger" if i % 3 == 0 else "illumina 1.5"
        wrong = 600 <= i < 640 and name != "sanger"
        rows.append((i, "r1", name, None, text(33 if name == "sanger" or wrong else 64), begin + timedelta(minutes=i)))
    rows += [(1000, "r1", "illumina 1.5", None, text(33), None), (1001, "r1", "illumina 1.5", None, "^^^^", begin + timedelta(minutes=610, seconds=30)), (1002, None, "illumina 1.5", None, "hhhh", begin)]
    sets = spark.createDataFrame(rows, "set_no bigint, run_id string, orig_format string, remark string, scores string, measured_at timestamp").withColumn("to", F.lit(1)).withColumn("_span", F.lit("x")).repartition(5)
    runs = spark.createDataFrame([("r1", "solexa")], "run_id string, qual_fmt string")
    got = {r["set_no"]: (r["orig_format"], r["phred_sum"]) for r in units.phred_sums(sets, runs).collect()}
    for i, _, name, _, scores, _ in rows:
        wrong = 600 <= i < 640 and name != "sanger"
        offset = 33 if name == "sanger" or wrong else 64
        assert got[i] == ("sanger" if offset == 33 else "illumina", sum(ord(c) - offset for c in scores))


def test_segments_across_blocks(spark):
    """Blocks of a history are joined: changes within them are found, ends of blocks aren't changes."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, 0.05, n) for m, n in ((0, 330), (0.6, 75), (0, 401), (-0.7, 194))])
    rows = [(k, i, 1, float(v) + k, 0.0) for k in (1, 2) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, at bigint, n bigint, x double, v double").repartition(4)
    for block in (100, 1 << 20):
        got = sorted(tuple(r) for r in units.segments_of(df, ["k"], 8.0, 0.08, block).select("k", "first_at", "last_at", "n_sets").collect())
        assert got == [(k, a, b, b - a + 1) for k in (1, 2) for a, b in ((0, 329), (330, 404), (405, 805), (806, 999))]
