"""Pattern search: exact, regular expressions, ambiguity codes and approximate matches.

``find`` adds ``_m``: for each pattern, best first, its hits. Predicates without coordinates are plain columns. Searches with
coordinates run on Arrow batches, once a record: approximate ones step through all texts of a batch at once, so no step is
taken for a single letter of a single record. All variables are columns over ``_m``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.ranges import Range
from ..lang.template import compile_template
from ..lang.values import INT, NUM, TEXT, ExpressionError, Value
from ..lang.variables import Context, constant

#: Letters that each ambiguity code of a pattern matches, by alphabet.
AMBIGUOUS_DNA = {"M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACGMRS", "H": "ACTMWY", "D": "AGTRWK", "B": "CGTSYK", "N": "ACGTMRWSYKVHDB"}
AMBIGUOUS_PROTEIN = {"B": "DN", "X": "ARNDCEQGHILKMFPSTWYVBZ", "Z": "EQ"}
ALPHABETS = (("dna", "ACGT", AMBIGUOUS_DNA), ("rna", "ACGU", {k: v.replace("T", "U") for k, v in AMBIGUOUS_DNA.items()}), ("protein", "ACDEFGHIKLMNPQRSTVWY", AMBIGUOUS_PROTEIN))
GAPS = "-.? "

HIT = "struct<start:int,end:int,dist:int,ins:int,del:int,subst:int,aligned:string,aligned_pattern:string,groups:array<struct<start:int,end:int>>>"
RESULT = f"array<struct<pattern:int,hits:array<{HIT}>>>"


def sequence_type(pattern: str) -> str:
    letters = {c for c in pattern.upper() if c not in GAPS}
    for name, plain, codes in ALPHABETS:
        if letters <= set(plain) | set(codes):
            return name
    return "other"


@dataclass(frozen=True)
class Search:
    """How to search; ``max_diffs`` or ``max_rate`` (of the pattern's length) allow differences."""

    patterns: tuple[tuple[str, str], ...]  # (name, text)
    regex: bool = False
    max_diffs: int = 0
    max_rate: float | None = None
    ambiguous: bool = True
    ignore_case: bool = False
    in_order: bool = False
    scoring: tuple[int, int, int] = (1, -1, -2)
    anchor_start: int | None = None
    anchor_end: int | None = None

    def __post_init__(self) -> None:
        if not self.patterns or any(not p for _, p in self.patterns):
            raise ExpressionError("empty pattern")
        if not self.regex and len({sequence_type(p) for _, p in self.patterns}) > 1:
            raise ExpressionError("patterns of different sequence types")

    def budget(self, pattern: str) -> int:
        return int(self.max_rate * len(pattern) + 1e-9) if self.max_rate is not None else self.max_diffs

    def codes(self) -> dict[str, str]:
        if not self.ambiguous or self.regex:
            return {}
        kind = sequence_type(self.patterns[0][1])
        return next((codes for name, _, codes in ALPHABETS if name == kind), {})

    def exact(self) -> bool:
        codes = self.codes()
        return not self.regex and not self.ignore_case and all(not self.budget(p) and not set(p) & set(codes) for _, p in self.patterns)


def read_patterns(spark: SparkSession, spec: str) -> tuple[tuple[str, str], ...]:
    """The patterns of an argument: one pattern, or with ``file:`` the records of a FASTA file, whose ids are the names.

    A file of patterns is part of the plan like the pattern of an argument, so it is read to the driver.
    """
    if not spec.startswith("file:"):
        return pattern_of(spec)
    from ..sources.files import read_records

    rows = read_records(spark, spec.removeprefix("file:"), "fasta").orderBy("_input", "_ord").collect()
    if not rows:
        raise ExpressionError(f"no patterns in {spec}")
    return tuple((r["id"], r["seq"]) for r in rows)


def pattern_of(text: str, name: str = "<pattern>") -> tuple[tuple[str, str], ...]:
    return ((name, text),)


#: Letters of a text that one lane of the automaton takes; longer texts get more lanes.
LANE = 4096
GAP_IN_TEXT, GAP_IN_PATTERN, PAIR, MISMATCH = range(4)
SIGN = np.frombuffer(b"ID=X", np.uint8)


class Approximate:
    """All ends within a budget by a bit-parallel automaton over many texts; starts and alignments by a traceback near each end."""

    def __init__(self, pattern: str, budget: int, codes: dict[str, str], ignore_case: bool, scoring: tuple[int, int, int]) -> None:
        self.p, self.k, self.m, self.scoring, self.fold = pattern.upper() if ignore_case else pattern, budget, len(pattern), scoring, ignore_case
        self.matches = [{c, *codes.get(c, "")} | ({x.lower() for x in codes.get(c.upper(), "")} if c.islower() else set()) for c in self.p]
        letters = sorted(set().union(*self.matches))
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        # the places of the pattern that a letter fits, 32 in a word; the last row is that of any other letter
        self.words = -(-self.m // 32)
        self.fits = np.zeros((len(letters) + 1, self.words), np.uint64)
        for i, own in enumerate(self.matches):
            for j, c in enumerate(letters):
                if c in own:
                    self.fits[j, i // 32] |= np.uint64(1 << i % 32)

    def rows_of(self, cp: np.ndarray) -> np.ndarray:
        """The row of ``fits`` of each letter."""
        at = np.minimum(np.searchsorted(self.letters, cp), len(self.letters) - 1)
        return np.where(self.letters[at] == cp, at, len(self.letters))

    def ends(self, kind: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, end, distance) of every end with a distance within the budget, by text and end. ``kind`` has the letters' rows."""
        warm = self.m + self.k
        lanes = np.maximum(1, -(-(n - warm) // LANE))
        text = np.repeat(np.arange(len(n)), lanes)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        size = np.minimum(n[text] - begin, LANE + warm)
        order = np.argsort(-size, kind="stable")
        text, begin, size = text[order], begin[order], size[order]
        place, full, top = first[text] + begin, np.uint64(0xFFFFFFFF), np.uint64((self.m - 1) % 32)
        one, shift = np.uint64(1), np.uint64(32)
        pv = [np.full(len(text), full) for _ in range(self.words)]
        mv = [np.zeros(len(text), np.uint64) for _ in range(self.words)]
        score = np.full(len(text), self.m)
        out: list[tuple] = []
        if self.m <= self.k:
            every = np.arange(len(n))
            out.append((every, np.zeros(len(n), np.int64), np.full(len(n), self.m)))
        active = len(text)
        for j in range(int(size.max(initial=0))):
            while active and size[active - 1] <= j:
                active -= 1
            row = self.fits[kind[place[:active] + j]]
            carry, plus, minus = np.uint64(0), np.uint64(0), np.uint64(0)
            for w in range(self.words):
                p, v, eq = pv[w][:active], mv[w][:active], row[:, w]
                xv = eq | v
                total = (eq & p) + p + carry
                carry = total >> shift
                xh = ((total & full) ^ p) | eq
                ph, mh = v | (~(xh | p) & full), p & xh
                if w == self.words - 1:
                    score[:active] += (ph >> top & one).view(np.int64) - (mh >> top & one).view(np.int64)
                up, down = ph >> np.uint64(31), mh >> np.uint64(31)
                ph, mh = (ph << one | plus) & full, (mh << one | minus) & full
                plus, minus = up, down
                pv[w][:active], mv[w][:active] = mh | (~(xv | ph) & full), ph & xv
            hit = np.flatnonzero(score[:active] <= self.k)
            if len(hit):
                # letters of the warm-up count for the lane before
                hit = hit[(begin[hit] == 0) | (j >= warm)]
                out.append((text[hit], begin[hit] + j + 1, score[hit]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        t, e, d = (np.concatenate(x).astype(np.int64) for x in zip(*out))
        order = np.lexsort((e, t))
        return t[order], e[order], d[order]

    def align(self, kind: np.ndarray, first: np.ndarray, end: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """(start, operations, score) of the alignments that end at ``end``; both gaps are tried before a pair of letters."""
        starts, ops, scores = [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
        step = max(1, (1 << 23) // ((self.m + 1) * (self.m + self.k + 1)))
        for at in range(0, len(end), step):
            s, o, c = self._align(kind, first[at : at + step], end[at : at + step], dist[at : at + step])
            starts.append(s)
            ops += o
            scores.append(c)
        return np.concatenate(starts), ops, np.concatenate(scores)

    def _align(self, kind: np.ndarray, first: np.ndarray, end: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        width, h = self.m + self.k, len(end)
        # the letters before each end; what lies before the text or beyond the alignment's reach fits nothing
        back = end[:, None] - width + np.arange(width)
        reach = back >= np.maximum(0, end - self.m - dist)[:, None]
        row = np.where(reach, kind[np.where(reach, first[:, None] + back, 0)] if len(kind) else 0, len(self.letters))
        cost = np.zeros((self.m + 1, h, width + 1), np.int16)
        column = np.arange(width + 1, dtype=np.int16)
        apart = np.zeros((self.m, h, width), bool)
        for i in range(1, self.m + 1):
            apart[i - 1] = self.fits[row, (i - 1) // 32] >> np.uint64((i - 1) % 32) & np.uint64(1) == 0
            best = cost[i - 1] + 1
            np.minimum(best[:, 1:], cost[i - 1][:, :-1] + apart[i - 1], out=best[:, 1:])
            cost[i] = np.minimum.accumulate(best - column, axis=1) + column
        i, j, own = np.full(h, self.m), np.full(h, width), np.arange(h)
        signs, used = np.zeros((h, self.m + width), np.uint8), 0
        match, mismatch, gap = self.scoring
        score = np.zeros(h, np.int64)
        while i.any():
            on = i > 0
            now, up = cost[i, own, j], cost[np.maximum(i - 1, 0), own, j]
            left = cost[i, own, np.maximum(j - 1, 0)]
            op = np.where(now == up + 1, GAP_IN_TEXT, np.where((j > 0) & (now == left + 1), GAP_IN_PATTERN, np.where(apart[np.maximum(i - 1, 0), own, np.maximum(j - 1, 0)], MISMATCH, PAIR)))
            score += np.where(on, np.array([gap, gap, match, mismatch])[op], 0)
            used += 1
            signs[:, -used] = np.where(on, SIGN[op], 0)
            i, j = i - (on & (op != GAP_IN_PATTERN)), j - (on & (op != GAP_IN_TEXT))
        return end - (width - j), [x.tobytes().lstrip(b"\0") for x in signs], score

    def hits(self, texts: list[str], in_order: bool, best_only: bool) -> list[list[tuple[int, int, int, bytes]]]:
        """For each text its (start, end, distance, operations); by distance, then place, or by place alone."""
        found: list[list] = [[] for _ in texts]
        folded = [t.upper() if len(t.upper()) == len(t) else "".join(u if len(u := c.upper()) == 1 else c for c in t) for t in texts] if self.fold else texts
        cp = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.fromiter(map(len, folded), np.int64, len(texts))
        kind, first = self.rows_of(cp), np.cumsum(n) - n
        t, e, d = self.ends(kind, first, n)
        if not self.k:
            for x, end in zip(t.tolist(), e.tolist()):
                found[x].append((end - self.m, end, 0, b"=" * self.m))
            return found
        if best_only and len(t):
            least = np.full(len(texts), self.k + 1)
            np.minimum.at(least, t, d)
            t, e, d = (x[d == least[t]] for x in (t, e, d))
            begin = np.full(len(texts), -1)
            begin[t[::-1]] = e[::-1]
            near = e <= begin[t] + 2 * d
            t, e, d = t[near], e[near], d[near]
        start, ops, score = self.align(kind, first[t], e, d)
        last: dict[int, int] = {}
        closed = set()
        for x, s, end, dist, o, c in zip(t.tolist(), start.tolist(), e.tolist(), d.tolist(), ops, score.tolist()):
            old = found[x][-1] if found[x] else None
            if old is None:
                found[x].append((s, end, dist, o))
                last[x] = c
            elif best_only:
                if s != old[0]:
                    closed.add(x)
                elif x not in closed and c > last[x]:
                    found[x][-1], last[x] = (s, end, dist, o), c
            elif old[0] != s:
                found[x].append((s, end, dist, o))
                last[x] = c
            elif (dist, -c) < (old[2], -last[x]):
                found[x][-1], last[x] = (s, end, dist, o), c
        return found if in_order or best_only else [sorted(f, key=lambda h: h[2]) for f in found]


def python_regex(pattern: str) -> str:
    return re.sub(r"\(\?<(?=[A-Za-z_])", "(?P<", pattern)


HIT_FIELDS = ("start", "end", "dist", "ins", "del", "subst", "aligned", "aligned_pattern", "groups")
GROUPS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _describe(hit: tuple[int, int, int, bytes], text: str, pattern: str) -> tuple:
    s, e, d, ops = hit
    if not d:
        return s, e, 0, 0, 0, 0, text[s:e], pattern, None
    at, pt, a, b = s, 0, [], []
    for o in ops:
        if o == 73:  # I
            a.append("-")
        else:
            a.append(text[at])
            at += 1
        if o == 68:  # D
            b.append("-")
        else:
            b.append(pattern[pt])
            pt += 1
    return s, e, d, ops.count(b"D"), ops.count(b"I"), ops.count(b"X"), "".join(a), "".join(b), None


def _searcher(search: Search, best_only: bool):
    n_patterns, whole = len(search.patterns), search.anchor_start is None and search.anchor_end is None
    if search.regex or search.exact():
        compiled = [re.compile(python_regex(p) if search.regex else re.escape(p), re.I if search.ignore_case else 0) for _, p in search.patterns]
        margin = [None if search.regex else len(p) for _, p in search.patterns]

        def of(k: int, texts: list[str]) -> list[list[tuple]]:
            p, x = search.patterns[k][1], compiled[k]
            groups = (lambda m: [{"start": m.start(g), "end": m.end(g)} for g in range(x.groups + 1)]) if search.regex else lambda m: None
            return [[(m.start(), m.end(), 0, 0, 0, 0, m.group(), p, groups(m)) for m in x.finditer(t)] for t in texts]
    else:
        machines = [Approximate(p, search.budget(p), search.codes(), search.ignore_case, search.scoring) for _, p in search.patterns]
        margin = [m.m + m.k for m in machines]

        def of(k: int, texts: list[str]) -> list[list[tuple]]:
            p = search.patterns[k][1]
            return [[_describe(h, t, p) for h in hits] for t, hits in zip(texts, machines[k].hits(texts, search.in_order, best_only and whole))]

    def moved(h: tuple, by: int) -> tuple:
        return h[0] + by, h[1] + by, *h[2:8], h[8] and [{"start": g["start"] + by, "end": g["end"] + by} for g in h[8]]

    def anchored(k: int, texts: list[str]) -> list[list[tuple]]:
        if search.anchor_start is not None:
            reach = None if margin[k] is None else margin[k] + search.anchor_start
            return [[h for h in hits if h[0] <= search.anchor_start][:1] for hits in of(k, [t[:reach] for t in texts])]
        if search.anchor_end is not None:
            cut = [0 if margin[k] is None else max(0, len(t) - margin[k] - search.anchor_end) for t in texts]
            found = of(k, [t[c:] for t, c in zip(texts, cut)])
            return [[moved(h, c) for h in hits if len(t) - (h[1] + c) <= search.anchor_end][-1:] for t, c, hits in zip(texts, cut, found)]
        return of(k, texts)

    def ranked(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        held = [i for i, t in enumerate(values) if t is not None]
        own = [values[i] for i in held]
        found = [anchored(k, own) for k in range(n_patterns)]
        found_of = dict(zip(held, zip(*found)))
        rank: list[int] = []
        hits: list[tuple] = []
        counts: list[int] = []
        for i in range(len(values)):
            each = found_of.get(i, ((),) * n_patterns)
            for k in sorted(range(n_patterns), key=lambda k: (not each[k], each[k][0][2] if each[k] else 0)):  # noqa: B023
                rank.append(k)
                counts.append(len(each[k]))
                hits += each[k]
        columns = list(zip(*hits)) if hits else [()] * len(HIT_FIELDS)
        kinds = [*[pa.int32()] * 6, pa.string(), pa.string(), GROUPS]
        flat = pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=list(HIT_FIELDS))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        inner = pa.StructArray.from_arrays([pa.array(rank, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=["pattern", "hits"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * n_patterns), inner)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield ranked(texts)

    return F.arrow_udf(run, RESULT)


def _shift(m: Column, by: Column) -> Column:
    group = lambda g: F.struct((g["start"] + by).alias("start"), (g["end"] + by).alias("end"))
    hit = lambda h: h.withField("start", h["start"] + by).withField("end", h["end"] + by).withField("groups", F.transform(h["groups"], group))
    return F.transform(m, lambda r: r.withField("hits", F.transform(r["hits"], hit)))


def has_match(search: Search, field: str = "seq") -> Column:
    """The predicate alone, for searches that need no Python; null text has no match."""
    c = F.col(field)
    if search.regex:
        out = [c.rlike(("(?i)" if search.ignore_case else "") + p) for _, p in search.patterns]
    elif search.exact():
        out = [F.contains(c, F.lit(p)) for _, p in search.patterns]
    elif not search.ignore_case and not any(search.budget(p) for _, p in search.patterns):
        out = [c.rlike("".join(map(_class, Approximate(p, 0, search.codes(), False, search.scoring).matches))) for _, p in search.patterns]
    else:
        raise ExpressionError("this search has no plain predicate")
    any_ = out[0]
    for o in out[1:]:
        any_ = any_ | o
    return F.coalesce(any_, F.lit(False))


def find(df: DataFrame, search: Search, field: str = "seq", rng: Range | None = None, hits: str = "all") -> DataFrame:
    """Adds ``_m`` and ``_hit`` (any pattern found). ``hits``: "best" where only hit 1 is asked for, then one alignment suffices.

    ``rng`` restricts the search; coordinates stay those of the whole text. Null text has no hits.
    """
    text = F.col(field)
    shift = F.lit(0)
    if rng is not None:
        s, e = rng.bounds(F.length(text))
        text, shift = F.substr(text, s + 1, e - s), s
    # texts that can't have a hit skip the search
    pieces = _seeds(search)
    m = _searcher(search, hits == "best")(text if pieces is None else F.when(text.rlike(pieces), text))
    if rng is not None:
        m = _shift(m, shift)
    return df.withColumn("_m", m).withColumn("_hit", F.exists(F.col("_m"), lambda r: F.size(r["hits"]) > 0))


def _class(letters: set[str]) -> str:
    return re.escape(*letters) if len(letters) == 1 else "[" + "".join(re.escape(c) for c in sorted(letters)) + "]"


def _seeds(search: Search) -> str | None:
    """An expression that any text with a hit matches, or None where none is selective.

    A hit within k differences holds one of k + 1 pieces of the pattern as it is, each letter as one that it stands for.
    """
    if search.regex or search.ignore_case:
        return None
    plain = next((set(letters) for name, letters, _ in ALPHABETS if name == sequence_type(search.patterns[0][1])), None)
    parts: list[str] = []
    for _, p in search.patterns:
        machine = Approximate(p, search.budget(p), search.codes(), False, search.scoring)
        k, size = machine.k, machine.m // (machine.k + 1)
        for i in range(k + 1):
            piece = machine.matches[i * size : (i + 1) * size if i < k else machine.m]
            # how much rarer than any text the piece is, in bits
            if sum(math.log2(len(plain or set("x" * 20)) / max(1, len(x & plain))) if plain else 4.0 for x in piece) < 6:
                return None
            parts.append("".join(map(_class, piece)))
    return "|".join(parts)


def matched(df: DataFrame) -> DataFrame:
    return df.where("_hit")


def unmatched(df: DataFrame) -> DataFrame:
    return df.where("NOT _hit")


def _put(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, spans, new in batches:
        out = []
        for t, hits, x in zip(texts.to_pylist(), spans.to_pylist(), new.to_pylist()):
            parts, at = [], 0
            for h in sorted(hits or (), key=lambda h: (h["s"], h["e"])):
                if h["s"] >= at:
                    parts += [t[at : h["s"]], x]
                    at = h["e"]
            out.append(t if t is None else "".join([*parts, t[at:]]))
        yield pa.array(out, pa.string())


def replace_hits(df: DataFrame, search: Search, template: str, field: str = "seq", ctx: Context | None = None) -> DataFrame:
    """Hits of the best pattern replaced, in the order of the text; a hit that overlaps one before it is left."""
    spans = F.transform(F.element_at("_m", 1)["hits"], lambda h: F.struct(h["start"].alias("s"), h["end"].alias("e")))
    new = compile_template(find_context(search, ctx, field), template).printed()
    found = F.size(F.element_at("_m", 1)["hits"]) > 0
    done = F.arrow_udf(_put, "string")(F.col(field), F.when(found, spans), F.when(found, new))
    return df.withColumn(field, done)


def find_context(search: Search, ctx: Context | None = None, field: str = "seq") -> Context:
    """A context with the variables of a search over the result of ``find``."""
    ctx = ctx or Context()
    text = F.col(field)
    length = F.length(text)
    names = F.array(*(F.lit(n) for n, _ in search.patterns))
    texts = F.array(*(F.lit(p) for _, p in search.patterns))

    def rank(v: Value | None) -> Column:
        return F.get("_m", F.lit(constant(v, 1, int) - 1))

    def over_hits(kind: str, value):
        def build(c: Context, hit: Value | None = None, pattern: Value | None = None, *rest: Value) -> Value:
            hits = rank(pattern)["hits"]
            which = "1" if hit is None else str(hit.const)
            if which == "all":
                return Value(F.when(F.size(hits) > 0, F.array_join(F.transform(hits, lambda h: Value(value(h, *rest), kind).text()), ",")), TEXT)
            i = int(which)
            h = F.get(hits, F.lit(i - 1)) if i > 0 else F.get(hits, F.size(hits) + i)
            return Value(F.when(h.isNotNull(), value(h, *rest)), kind)

        return build

    def add(name: str, kind: str, value) -> None:
        ctx.extra[name] = over_hits(kind, value)

    one = lambda h: h["start"] + 1
    add("match", TEXT, lambda h: F.substr(text, h["start"] + 1, h["end"] - h["start"]))
    add("aligned_match", TEXT, lambda h: h["aligned"])
    add("match_start", INT, one)
    add("match_end", INT, lambda h: h["end"])
    add("match_neg_start", INT, lambda h: h["start"] - length)
    add("match_neg_end", INT, lambda h: h["end"] - length - 1)
    add("match_len", INT, lambda h: h["end"] - h["start"])
    delim = lambda d: constant(d, ":", str)
    joined = lambda a, b, d: F.concat(a.cast("string"), F.lit(delim(d)), b.cast("string"))
    add("match_range", TEXT, lambda h, d=None: joined(one(h), h["end"], d))
    add("match_neg_range", TEXT, lambda h, d=None: joined(h["start"] - length, h["end"] - length - 1, d))
    for n, f in (("match_diffs", "dist"), ("match_ins", "ins"), ("match_del", "del"), ("match_subst", "subst")):
        add(n, INT, lambda h, f=f: h[f])

    def diff_rate(c: Context, hit: Value | None = None, pattern: Value | None = None) -> Value:
        size = F.length(F.element_at(texts, rank(pattern)["pattern"] + 1))
        return over_hits(NUM, lambda h: h["dist"] / size)(c, hit, pattern)

    ctx.extra["match_diff_rate"] = diff_rate
    add("aligned_pattern", TEXT, lambda h: h["aligned_pattern"])
    found = lambda v, c: F.when(F.size(rank(v)["hits"]) > 0, F.element_at(c, rank(v)["pattern"] + 1))
    ctx.extra["pattern_name"] = lambda c, r=None: Value(found(r, names), TEXT)
    ctx.extra["pattern"] = lambda c, r=None: Value(found(r, texts), TEXT)
    ctx.extra["pattern_len"] = lambda c, r=None: Value(F.length(found(r, texts)).cast("bigint"), INT)

    def group_number(g: Value) -> int:
        k = str(g.const)
        if k.isdigit():
            return int(k)
        found_ = {re.compile(python_regex(p)).groupindex.get(k) for _, p in search.patterns}
        if len(found_) != 1 or None in found_:
            raise ExpressionError(f"group {k!r} isn't the same group in all patterns")
        return found_.pop()

    def group(kind: str, value):
        def build(c: Context, g: Value, hit: Value | None = None, pattern: Value | None = None, *rest: Value) -> Value:
            i = group_number(g)

            def of(h: Column, *r: Value) -> Column:
                x = F.get(h["groups"], F.lit(i))
                return F.when(x["start"] >= 0, value(x, *r)).otherwise(F.raise_error(F.lit(f"group {i} took no part in the match")).cast("string" if kind == TEXT else "bigint"))

            return over_hits(kind, of)(c, hit, pattern, *rest)

        return build

    ctx.extra["match_group"] = group(TEXT, lambda x: F.substr(text, x["start"] + 1, x["end"] - x["start"]))
    ctx.extra["match_grp_start"] = group(INT, lambda x: (x["start"] + 1).cast("bigint"))
    ctx.extra["match_grp_end"] = group(INT, lambda x: x["end"].cast("bigint"))
    ctx.extra["match_grp_neg_start"] = group(INT, lambda x: (x["start"] - length).cast("bigint"))
    ctx.extra["match_grp_neg_end"] = group(INT, lambda x: (x["end"] - length - 1).cast("bigint"))
    ctx.extra["match_grp_range"] = group(TEXT, lambda x, d=None: joined(x["start"] + 1, x["end"], d))
    return ctx


def explode_hits(df: DataFrame, search: Search) -> DataFrame:
    """One row a hit: id, pattern name, start (from 1), end, dist."""
    names = F.array(*(F.lit(n) for n, _ in search.patterns))
    one = df.select("id", F.explode("_m").alias("_r")).select("id", F.element_at(names, F.col("_r.pattern") + 1).alias("pattern_name"), F.explode("_r.hits").alias("_h"))
    return one.select("id", "pattern_name", (F.col("_h.start") + 1).alias("start"), F.col("_h.end").alias("end"), F.col("_h.dist").alias("dist"))
