"""Quality scores written in four formats, brought to Phred.

The history of each source is segmented by an exact penalised changepoint search on log levels. A source is the rows
of one run whose names claim one coding (offset 33 or 64); there the level should stay, however often formats alternate in
the run. A segment whose level is off the source's by a known offset change holds rows that are coded otherwise than
their names say: these are read with the other offset if their codes can't stand for scores under the named one.
All other rows keep the format that their label, their remark or their run names, as names are what tells
formats of one offset apart (illumina and solexa, or numbers).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

FORMATS = ("sanger", "illumina", "solexa", "phred")
OFFSET = {"sanger": 33, "illumina": 64, "solexa": 64}


def _like(text: Column, word: str, edits: int) -> Column:
    """Some word of ``text`` is ``word`` but for a few edits."""
    return F.exists(F.split(text, "[^\\p{L}]+"), lambda w: F.levenshtein(w, F.lit(word)) <= edits)


NEW_VERSION = r"1[._](?:8|9|[1-9][0-9])(?![0-9])"
NAME = r"(?:sang[a-z]*|il+umina|solex[a-z]*|phred)"


def _named(t: Column, numbers: Column, loose: bool) -> Column:
    edits = 2 if loose else 1
    at = lambda n: t.rlike(rf"(?:offset|phred|ascii|sanger|illumina|solexa)\s*\(?\+?\s*(?:offset\s*)?{n}(?![0-9])|\+{n}(?![0-9])")
    return (
        F.when(_like(t, "solexa", edits), "solexa")
        .when(_like(t, "illumina", edits), F.when(t.rlike(NEW_VERSION), "sanger").otherwise("illumina"))
        .when(_like(t, "sanger", edits), "sanger")
        .when(at(33), "sanger")
        .when(at(64), "illumina")
        .when(numbers, "phred")
    )


def label_format(label: Column) -> Column:
    """The format a label names, or null. Null, empty and unknown labels give null."""
    t = F.trim(F.lower(label))
    return F.coalesce(_named(t, _like(t, "phred", 1) | t.rlike(r"(^|[^a-z])qual([^a-z]|$)"), True), F.when(t.rlike(r"^(fq|fastq)$"), "sanger"))


def remark_format(remark: Column) -> Column:
    """The format that the scores have now by a free remark, or null; a former format doesn't count."""
    t = F.lower(remark)
    former = rf"\b(?:was|were|formerly|originally|previously|(?:converted|decoded|recoded|changed|translated|moved) from)\s+(?:in\s+|as\s+)?{NAME}(?:[\s_]*1\.[0-9]+(?:-1\.[0-9]+)?\+?)?"
    now = F.regexp_replace(t, former, " ")
    return _named(now, _like(now, "phred", 0) | now.rlike(r"(^|[^a-z])qual (file|numbers)|\.qual"), False)


def with_format(sets: DataFrame, runs: DataFrame) -> DataFrame:
    """``sets`` with ``fmt``: from orig_format; if that is null from remark; if that tells none, from the run."""
    own = F.when(F.col("orig_format").isNotNull(), label_format(F.col("orig_format"))).otherwise(remark_format(F.col("remark")))
    by_run = runs.select(F.col("run_id").alias("_run"), F.col("qual_fmt").alias("_run_fmt"))
    return sets.join(by_run, F.col("run_id") == F.col("_run"), "left").withColumn("fmt", F.coalesce(own, F.when(F.col("orig_format").isNull(), label_format(F.col("_run_fmt"))))).drop("_run", "_run_fmt")


def solexa_to_phred(s: Column) -> Column:
    return F.floor(F.lit(10.0) * F.log10(F.pow(F.lit(10.0), s / F.lit(10.0)) + F.lit(1.0)) + F.lit(0.5)).cast("int")


def phred_scores(scores: Column, fmt: Column) -> Column:
    """Array of Phred scores. Numbers may be parted by anything but digits and signs."""
    codes = _codes(scores)
    numbers = F.transform(F.regexp_extract_all(scores, F.lit(r"-?[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    return (
        F.when(fmt == "sanger", F.transform(codes, lambda c: c - 33))
        .when(fmt == "illumina", F.transform(codes, lambda c: c - 64))
        .when(fmt == "solexa", F.transform(codes, lambda c: solexa_to_phred(c - 64)))
        .when(fmt == "phred", numbers)
    )


CODES = "struct<n:int,total:bigint,least:int,most:int,phred_sum:bigint>"
_SOLEXA = np.floor(10.0 * np.log10(10.0 ** ((np.arange(128) - 64) / 10.0) + 1.0) + 0.5).astype(np.int64)


def _code_sums(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """For scores that aren't empty and their format: the number of codes, their sum, least and most, and the sum of the Phred scores; all texts of a batch at once."""
    for scores, fmt in batches:
        texts, names = scores.to_pylist(), np.array(fmt.to_pylist(), object)
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(n) - n
        total, least, most = np.add.reduceat(cp, first), np.minimum.reduceat(cp, first), np.maximum.reduceat(cp, first)
        # codes beyond ASCII have scores far above any other; the formula gives their distance from 64
        solexa = np.add.reduceat(np.where(cp < 128, _SOLEXA[np.minimum(cp, 127)], cp - 64), first)
        sums = np.select([names == "sanger", names == "illumina", names == "solexa"], [total - 33 * n, total - 64 * n, solexa], 0)
        for i in np.flatnonzero(names == "phred"):
            sums[i] = sum(map(int, re.findall(r"-?[0-9]+", texts[i])))
        yield pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(total), pa.array(least, pa.int32()), pa.array(most, pa.int32()), pa.array(sums)], names=["n", "total", "least", "most", "phred_sum"])


def _read(sets: DataFrame, runs: DataFrame, penalty: float, tolerance: float, scores: bool) -> DataFrame:
    """(set_no, orig_format, phred_sum) of rows with a known format, with their ``scores`` if asked for; formats as the segments of their source leave them."""
    time = F.col("measured_at").cast("timestamp") if "measured_at" in sets.columns else F.lit(None).cast("timestamp")
    sets = sets.where(F.col("scores") != "").select("set_no", "run_id", "orig_format", "remark", "scores", F.unix_micros(time).alias("_at"))
    named = with_format(sets, runs).where(F.col("fmt").isNotNull()).withColumn("_c", F.arrow_udf(_code_sums, CODES)("scores", "fmt"))
    offset = F.when(F.col("fmt") == "sanger", 33).when(F.col("fmt").isin("illumina", "solexa"), 64)
    # names and codes are read once
    named = stage(named.select("set_no", F.coalesce("run_id", F.lit("")).alias("_run"), offset.alias("_offset"), "_at", "fmt", "_c.*", *(["scores"] if scores else [])), "levels")
    level = F.log(F.greatest(F.lit(1.0), F.col("total") / F.col("n")))
    levels = history(named.where("_offset IS NOT NULL AND _at IS NOT NULL"), ["_run", "_offset"], F.col("_at"), level)
    # few segments are off, each is told by the blocks of time it reaches into
    off = segments_of(levels, ["_run", "_offset"], penalty, tolerance).where("to IS NOT NULL")
    off = off.select("_run", "_offset", "first_at", "last_at", "to", F.explode(F.sequence(F.shiftright("first_at", 36), F.shiftright("last_at", 36))).alias("_span")).alias("o")
    rows = named.withColumn("_span", F.shiftright("_at", 36)).alias("r")
    same = (F.col("r._run") == F.col("o._run")) & (F.col("r._offset") == F.col("o._offset")) & (F.col("r._span") == F.col("o._span")) & F.col("r._at").between(F.col("o.first_at"), F.col("o.last_at"))
    # an exact check of what the segment says: some code can't be one of the named format
    lowest = F.when(F.col("fmt") == "sanger", 33).when(F.col("fmt") == "illumina", 64).otherwise(59)
    moved = F.col("to").isNotNull() & ((F.col("least") < lowest) | (F.col("most") > 126))
    read = F.when(moved, F.when(F.col("to") == 33, "sanger").otherwise("illumina")).otherwise(F.col("fmt"))
    phred_sum = F.when(moved, F.col("total") - F.col("n") * F.col("to")).otherwise(F.col("phred_sum"))
    return rows.join(off, same, "left").select("set_no", read.alias("orig_format"), phred_sum.alias("phred_sum"), *(["scores"] if scores else []))


def to_phred(sets: DataFrame, runs: DataFrame, penalty: float = 8.0, tolerance: float = 0.08) -> DataFrame:
    """(set_no, orig_format, phred) of rows with non-empty scores and a known format.

    Null or empty scores, unknown labels and runs that aren't listed leave a row out. Rows
    delivered twice stay two rows. Rows without a time belong to no history and keep the named format. ``runs`` has one row per run_id.
    """
    return _read(sets, runs, penalty, tolerance, True).select("set_no", "orig_format", phred_scores(F.col("scores"), F.col("orig_format")).alias("phred"))


def _codes(scores: Column) -> Column:
    return F.transform(F.filter(F.split(scores, ""), lambda c: c != ""), F.ascii)


def phred_sums(sets: DataFrame, runs: DataFrame, penalty: float = 8.0, tolerance: float = 0.08) -> DataFrame:
    """(set_no, orig_format, phred_sum) of the rows of ``to_phred``, without duplicate rows."""
    return _read(sets, runs, penalty, tolerance, False).distinct()


def segment(x: np.ndarray, w: np.ndarray, penalty: float) -> list[int]:
    """Starts of the segments of least weighted squared deviation plus ``penalty`` a segment; exact.

    Dynamic programming over the level of the open segment: each start is kept only with the levels for which it is the best one so
    far, so long histories without a change have few starts to compare.
    """
    n = len(x)
    if not n:
        return []
    x = x - np.average(x, weights=w)
    cw, cx, cxx = (np.concatenate([[0.0], np.cumsum(v)]) for v in (w, w * x, w * x * x))
    best, last = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    least, most = float(x.min()), float(x.max())
    start, lo, hi = np.array([0]), np.array([least]), np.array([most])
    for j in range(1, n + 1):
        weight, total = cw[j] - cw[start], cx[j] - cx[start]
        level = total / weight
        cost = best[start] + (cxx[j] - cxx[start]) - total * level
        k = int(cost.argmin())
        best[j], last[j] = cost[k] + penalty, start[k]
        # a new start at j costs best[j] + penalty at any level
        radius = np.sqrt(np.maximum(best[j] - cost, 0) / weight)
        low, high = np.maximum(lo, level - radius), np.minimum(hi, level + radius)
        keep = (low <= high) & (cost <= best[j])
        start, low, high = start[keep], low[keep], high[keep]
        after, before = np.append(least, high), np.append(low, most)
        gap = after < before
        if gap.any():
            start, lo, hi = np.append(start, np.full(np.count_nonzero(gap), j)), np.append(low, after[gap]), np.append(high, before[gap])
            order = lo.argsort(kind="stable")
            start, lo, hi = start[order], lo[order], hi[order]
        else:
            lo, hi = low, high
    cuts, j = [], n
    while j > 0:
        cuts.append(int(last[j]))
        j = last[j]
    return cuts[::-1]


NUMBERS = r"^[\s\[({]*-?[0-9]{1,3}(?:[\s,;|]+-?[0-9]{1,3})*[\s\])}]*$"
#: Time stamps that one search takes at once; searches of longer histories are joined by one over their segments.
BLOCK = 20_000


def history(rows: DataFrame, keys: list[str], at: Column, level: Column) -> DataFrame:
    """(keys, at, n, x, v): one weighted log level for each time stamp, combined on the map side, so rows of one time are no larger task than one row."""
    return rows.select(*keys, at.alias("at"), level.alias("x")).groupBy(*keys, "at").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.var_pop("x").alias("v"))


def segments_of(levels: DataFrame, keys: list[str], penalty: float, tolerance: float, block: int = BLOCK) -> DataFrame:
    """Segments of each history: (keys, segment, first_at, last_at, n_sets, level, shift, matched, to).

    Histories are sorted in ranges over all tasks and searched in blocks of ``block`` stamps; a second search over the segments of a
    history joins what the ends of blocks have cut. A history of one block is searched exactly, of a longer one all changes but those
    that only show across the end of a block. ``shift`` is the change of the log level from the segment before, ``matched`` the
    offset change (0 are numbers) that fits it best; ``to`` is the offset that the segment has instead of 33 or 64 by its level
    against the longest segment, where the last key is an offset.
    """
    types = dict(levels.dtypes)
    own = ", ".join(f"{k} {types[k]}" for k in keys)
    cut = f"{own}, first_at bigint, last_at bigint, stamps bigint, n bigint, x double, spread double, free bigint"

    def search(batches):
        held: list[pd.DataFrame] = []

        def close(pdf: pd.DataFrame) -> pd.DataFrame:
            at, x, n, v = pdf["at"].to_numpy(), pdf["x"].to_numpy(), pdf["n"].to_numpy(float), pdf["v"].to_numpy()
            spread = float((n * v).sum() + (np.diff(x) ** 2 / (1 / n[1:] + 1 / n[:-1])).sum())
            noise = max(spread / max(n.sum() - 1, 1), 1e-6)
            cuts = [*segment(x, n / noise, penalty), len(x)]
            head = [pdf[k].iloc[0] for k in keys]
            rows = [(*head, int(at[a]), int(at[b - 1]), b - a, int(n[a:b].sum()), float(np.average(x[a:b], weights=n[a:b])), spread if not a else 0.0, int(n.sum()) - 1 if not a else 0) for a, b in zip(cuts, cuts[1:])]
            return pd.DataFrame(rows, columns=[*keys, "first_at", "last_at", "stamps", "n", "x", "spread", "free"])

        for pdf in batches:
            for _, part in pdf.groupby(keys, sort=False, dropna=False):
                if held and any(held[-1][k].iloc[0] != part[k].iloc[0] for k in keys):
                    yield close(pd.concat(held))
                    held = []
                while sum(map(len, held)) + len(part) >= block:
                    room = block - sum(map(len, held))
                    yield close(pd.concat([*held, part.iloc[:room]]))
                    held, part = [], part.iloc[room:]
                if len(part):
                    held.append(part)
        if held:
            yield close(pd.concat(held))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first_at")
        x, n = pdf["x"].to_numpy(), pdf["n"].to_numpy(float)
        noise = max(float(pdf["spread"].sum()) / max(int(pdf["free"].sum()), 1), 1e-6)
        cuts = [*segment(x, n / noise, penalty), len(x)]
        means = [float(np.average(x[a:b], weights=n[a:b])) for a, b in zip(cuts, cuts[1:])]
        sizes = [n[a:b].sum() for a, b in zip(cuts, cuts[1:])]
        usual = means[int(np.argmax(sizes))]
        out = []

        def nearest(level: float, shift: float, offsets: list[tuple[int, int]]) -> tuple[int, int] | None:
            up = math.exp(level)
            off = {(p, q): abs(shift - math.log((up - p + q) / up)) for p, q in offsets if up - p + q >= 1}
            best = min(off, key=off.get, default=None)
            return best if best and off[best] < tolerance else None

        every = [(p, q) for p in (0, 33, 64) for q in (0, 33, 64) if p != q]
        named = pdf[keys[-1]].iloc[0]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            shift = means[i] - means[i - 1] if i else None
            found = nearest(means[i - 1], shift, every) if i else None
            other = nearest(usual, means[i] - usual, [(p, q) for p, q in every if p == named and q]) if named in (33, 64) else None
            out.append((*(pdf[k].iloc[0] for k in keys), i, int(pdf["first_at"].iloc[a]), int(pdf["last_at"].iloc[b - 1]), int(sizes[i]), math.exp(means[i]), shift, found and f"{found[0]}->{found[1]}", other and other[1]))
        return pd.DataFrame(out, columns=[*keys, "segment", "first_at", "last_at", "n_sets", "level", "shift", "matched", "to"])

    pieces = levels.select(*keys, "at", "n", "x", "v").repartitionByRange(*keys, "at").sortWithinPartitions(*keys, "at").mapInPandas(search, cut)
    return pieces.groupBy(*keys).applyInPandas(join, f"{own}, segment int, first_at bigint, last_at bigint, n_sets bigint, level double, shift double, matched string, to int")


def level_segments(sets: DataFrame, penalty: float = 8.0, tolerance: float = 0.08) -> DataFrame:
    """Segments of each run's history of levels: the mean of a row's codes, or of its numbers if they are written out.

    The history is whole, and takes the rows as they are, whatever they are named. Rows without run, time or scores take no part.
    """
    numbers = F.transform(F.regexp_extract_all(F.col("scores"), F.lit(r"-?[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    values = F.when(F.col("scores").rlike(NUMBERS), numbers).otherwise(_codes(F.col("scores")))
    rows = sets.where((F.col("scores") != "") & F.col("run_id").isNotNull() & F.col("measured_at").isNotNull()).select("run_id", F.unix_micros(F.col("measured_at").cast("timestamp")).alias("at"), values.alias("values"))
    # numbers may be zero or less, which have no log
    level = F.greatest(F.lit(1.0), F.aggregate("values", F.lit(0.0), lambda a, c: a + c) / F.size("values"))
    found = segments_of(history(rows, ["run_id"], F.col("at"), F.log(level)), ["run_id"], penalty, tolerance)
    return found.select("run_id", "segment", F.timestamp_micros("first_at").alias("first_at"), F.timestamp_micros("last_at").alias("last_at"), "n_sets", "level", "shift", "matched")
