import random
import re

import pytest
from pyspark.sql import functions as F

from strandframe.functions import numbers, sequence
from strandframe.functions.attrs import AttrFormat
from strandframe.lang.values import ExpressionError
from strandframe.lang.variables import Context
from strandframe.model import records
from strandframe.operators import align, basic, keyed, search

READS = [("m4", "w=7 site=fen", "GATTACAGATTACA"), ("m1", "w=30", "CCGGA-TTAACC"), ("m3", "w=4", "ccggaattaacc"), ("m2", None, "TTTTGACCGG--"), ("m5", "w=12", "GATTACAGATTACA"), ("m6", "site=bog w=100", "")]


def make(spark, rows, parts=1):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "o int, id string, desc string, seq string").repartition(parts)
    return records(df, id="id", desc="desc", seq="seq", order="o")


def ids(df):
    return [r["id"] for r in df.collect()]


def weight(desc):
    m = re.search(r"(?:^| )w=(\d+)", desc or "")
    return m and m.group(1)


def share(seq):
    letters = [c for c in seq if c in "ACGTU"]
    return sum(c in "GC" for c in letters) / len(letters) if letters else None


KEYS = {"seq": lambda r: r[2], "id": lambda r: r[0], "opt_attr(w)": lambda r: weight(r[1]), "{num(opt_attr('w'))}": lambda r: weight(r[1]) and int(weight(r[1])), "seqlen": lambda r: len(r[2]), "gc": lambda r: share(r[2])}


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("key", KEYS)
@pytest.mark.parametrize("reverse", [False, True])
def test_sort(spark, parts, key, reverse):
    rows = [r for r in READS if key != "gc" or share(r[2]) is not None]
    of = KEYS[key]
    known, unknown = [r for r in rows if of(r) is not None], [r for r in rows if of(r) is None]
    known = sorted(known, key=of, reverse=reverse)  # Python's sort keeps ties in input order, also reversed
    want = unknown + known if reverse else known + unknown
    assert ids(basic.sort(make(spark, rows, parts), key, reverse=reverse)) == [r[0] for r in want]


def test_unique_and_counts(spark):
    df = make(spark, READS, 3)
    first: dict = {}
    for r in READS:
        first.setdefault(r[2].upper(), r[0])
    assert sorted(ids(keyed.unique(df, "upper_seq"))) == sorted(first.values())
    n: dict = {}
    for _, _, s in READS:
        k = str(len(s)), str(len(s.replace("-", "")))
        n[k] = n.get(k, 0) + 1
    got = [tuple(r) for r in basic.count_by(df, "seqlen,ungapped_seqlen").collect()]
    assert got == [(*k, c) for k, c in sorted(n.items(), key=lambda x: [int(v) for v in x[0]])]
    with pytest.raises(Exception, match="more than 1 categories"):
        basic.count_by(df, "id", limit=1).collect()
    assert basic.count_by(df.limit(0), "id").collect() == []


def test_counts_of_equal_prints(spark):
    """Numbers that print alike are one category; bins and undefined values have their place in the order."""
    df = make(spark, [(str(i), d, "A") for i, d in enumerate(["v=0.3", "v=0.30000000000000004", None, "v=12", "v=-1", "v=2.5", "v=nan"])])
    got = [tuple(r) for r in basic.count_by(df, "{bin(num(opt_attr('v')), 5)}").collect()]
    assert got[:3] == [("(-5, 0]", 1), ("(0, 5]", 3), ("(10, 15]", 1)] and {k for k, _ in got[3:]} == {"(NaN, NaN]", "undefined"}
    assert [tuple(r) for r in basic.count_by(df.limit(2), "{num(opt_attr('v')) + 1e-12}").collect()] == [("0.300000", 2)]


def test_map(spark):
    rows = [("t1", "g=x", "A"), ("t2", "g=y", "A"), ("t3", "g=x", "C"), ("t4", "g=x", "A"), ("t5", "g=y", "G")]
    df = make(spark, rows, 2)
    groups: dict = {}
    for i, d, _ in rows:
        groups.setdefault(d[2:], []).append(i)
    wide = {
        "long": [(i, g[0]) for g in groups.values() for i in g], "long-star": [(i, "*" if i == g[0] else g[0]) for g in groups.values() for i in g],
        "wide": [("\t".join(g),) for g in groups.values()], "wide-comma": [(g[0] + "\t" + ",".join(g),) for g in groups.values()], "wide-key": [(k + "\t" + "\t".join(g),) for k, g in groups.items()],
    }
    for fmt, want in wide.items():
        assert [tuple(r) for r in keyed.unique_map(df, "attr(g)", fmt).collect()] == want


@pytest.mark.parametrize(("x", "text"), [(1.2, "1.2"), (1.1 + 0.1, "1.20000"), (1.1000001, "1.10000"), (1e-14, "1e-14"), (1.1e-14, "1.1e-14"), (1.10135e19, "1.10135e19"), (40.0, "40"), (0.4, "0.4"), (-2.5, "-2.5"), (0.0, "0"), (float("nan"), "NaN"), (float("inf"), "Infinity"), (None, None)])
def test_numbers(spark, x, text):
    df = spark.createDataFrame([(x,)], "x double")
    assert df.select(numbers.format_double(F.col("x"))).first()[0] == text


def table(df, fields, ctx=None):
    return [",".join(r) for r in basic.table(df, fields, ctx).collect()]


def test_templates_and_expressions(spark):
    df = make(spark, READS[:1])
    assert table(df, "id,{seqlen},{attr(w)},{num(attr('w')) + 1},{attr('w')+1},{opt_attr('z') + 1},{bin(seqlen,10)},a{id}b") == ["m4,14,7,8,71,NaN,(10, 20],am4b"]
    assert table(df, ["{seqlen > 10 ? 'long' : 'short'}", "{if (seqlen > 30) return 1; return 'x';}", "{id.slice(-1)}", "{parseInt('12ab')}"]) == ["long,x,4,12"]
    assert ids(basic.filter_records(make(spark, READS), "opt_attr('w') >= 10")) == [r[0] for r in READS if weight(r[1]) and int(weight(r[1])) >= 10]
    assert ids(basic.filter_records(make(spark, READS), "(new RegExp('m[12]')).test(id)")) == ["m1", "m2"]
    for bad in ("seqlen +", "nosuch > 1", "seqlen"):
        with pytest.raises(ExpressionError):
            basic.filter_records(df, bad)


def test_ranges(spark):
    df = make(spark, [("id", None, "ABCDEFGHIJ")])
    one = lambda r, **k: basic.trim(df, r, **k).first()["seq"]
    assert (one("2:4,6:7"), one("-4:-3,-1:"), one(":"), one("2:-2"), one("3:2"), one("20:")) == ("BCDFG", "GHJ", "ABCDEFGHIJ", "BCDEFGHI", "", "")
    assert one("2:4", zero_based=True) == "CD"
    assert one("2:4", exclusive=True) == "C"
    assert basic.mask(df, "2:3,-1:").first()["seq"] == "AbcDEFGHIj"
    assert basic.mask(df, ":2", hard="N").first()["seq"] == "NNCDEFGHIJ"
    assert basic.trim(make(spark, [("id", "s=undefined e=3", "ABCDE")]), "{opt_attr(s)}:{attr(e)}").first()["seq"] == "ABC"


def test_attributes(spark):
    df = make(spark, [("s", "a=0 b=3", "ATGC"), ("t", None, "A"), ("u", "a=undefined", "A")])
    assert [r["desc"] for r in basic.set_attrs(df, edit={"b": "{seqlen}"}).collect()] == ["a=0 b=4", "b=1", "a=undefined b=1"]
    assert [r["desc"] for r in basic.delete(df, attrs=["a"]).collect()] == ["b=3", None, ""]
    assert table(df, "opt_attr(a),{has_attr('a')}") == ["0,true", "undefined,false", "undefined,false"]
    with pytest.raises(Exception, match="no attribute"):
        basic.table(df, "attr(b)").collect()
    f = AttrFormat.parse("|key:value")
    assert table(make(spark, [("s|c:2|d:5", None, "A")]), "attr(c),attr(d)", Context(attr_format=f)) == ["2,5"]


def test_sequence_functions(spark):
    pairs = {"A": "T", "C": "G", "R": "Y", "K": "M", "B": "V", "D": "H", "S": "S", "W": "W", "N": "N"}
    both = pairs | {v: k for k, v in pairs.items()}
    letters = "".join(random.Random(1).choices(sorted(both), k=60))
    df = make(spark, [("i", None, letters)])
    assert basic.revcomp(df, "dna").first()["seq"] == "".join(both[c] for c in reversed(letters))
    codes = ["!I5", "", None, "~~"]
    q = spark.createDataFrame([(c,) for c in codes], "qual string")
    want = [None if c is None else sum(10 ** (-(ord(x) - 33) / 10) for x in c) for c in codes]
    assert [r[0] for r in q.select(sequence.exp_err(F.col("qual"))).collect()] == [w if w is None else pytest.approx(w) for w in want]
    phred = spark.createDataFrame([("2 41 0",)], "s string").select(sequence.quality_of_phred(F.col("s"))).first()[0]
    assert phred == "".join(chr(33 + x) for x in (2, 41, 0))


def find(spark, rows, pattern, fields, **k):
    se = search.Search(pattern if isinstance(pattern, tuple) else search.pattern_of(pattern), **k)
    return table(search.find(make(spark, rows), se), fields, search.find_context(se))


#: Letters of codes, for the brute-force searches.
CODES = {"N": "ACGTMRWSYKVHDBN", "R": "AGR"}


def distances(text, pattern):
    """Edit distance of the pattern to each part (start, end) of a text."""
    fits = lambda p, c: c == p or c in CODES.get(p, "")
    out = {}
    for s in range(len(text) + 1):
        row = list(range(len(pattern) + 1))
        out[s, s] = row[-1]
        for e in range(s, len(text)):
            new = [row[0] + 1]
            for i, p in enumerate(pattern):
                new.append(min(row[i] + (not fits(p, text[e])), row[i + 1] + 1, new[i] + 1))
            row = new
            out[s, e + 1] = row[-1]
    return out


VARIABLES = "id,match_start,match_end,match_diffs,match_ins,match_del,match_subst,match,aligned_match,aligned_pattern,match_len,match_range,match_neg_start,match_neg_end,match_neg_range,match_diff_rate,pattern_name,pattern,pattern_len".split(",")


@pytest.mark.parametrize(("pattern", "budget"), [("ACGTAC", 2), ("GANTRC", 1), ("GARTNC", 0), ("TTGACCA", 3), ("ACGT" * 9 + "TG", 4), ("CATGCATTGACCAGTAGGACTAACCGTACGTTAGCATTAACGGATCATTTGCAATCGACGTAGG", 3)])
def test_find_against_brute_force(spark, pattern, budget):
    rng = random.Random(len(pattern) + budget)
    plain = "".join(rng.choice(CODES.get(c, c)[:4].translate({ord("M"): "A", ord("R"): "G"})) for c in pattern)
    texts = ["", "A"]
    for _ in range(30):
        s = list(plain)
        for _ in range(rng.randint(0, budget + 1)):
            s[rng.randrange(len(s))] = rng.choice(["", "A", "CG", "T"])
        texts.append("".join(rng.choices("ACGT", k=rng.randint(0, 20))) + "".join(s) + "".join(rng.choices("ACGT", k=rng.randint(0, 9))))
    rows = [(str(i), None, t) for i, t in enumerate(texts)]
    se = search.Search((("one", pattern),), max_diffs=budget)
    best = search.find(make(spark, rows, 2), se, hits="best")
    values = basic.table(best, VARIABLES, search.find_context(se)).collect()
    every = {r["id"]: r["_m"][0]["hits"] for r in search.find(make(spark, rows, 2), se).select("id", "_m").collect()}
    by_id = {v[0]: v for v in values}
    for i, t in enumerate(texts):
        d = distances(t, pattern)
        ends = {e for (s, e), x in d.items() if x <= budget}
        hits = every[str(i)]
        assert bool(hits) == bool(ends) and all(d[h["start"], h["end"]] == h["dist"] <= budget for h in hits)
        assert len({h["start"] for h in hits}) == len(hits) and [h["dist"] for h in hits] == sorted(h["dist"] for h in hits)
        # of each start that some end's best alignment has, the hit is at least as near as any other end's
        v = dict(zip(VARIABLES, by_id[str(i)]))
        if not ends:
            assert set(v.values()) == {str(i), "undefined"}
            continue
        s, e, n = int(v["match_start"]) - 1, int(v["match_end"]), len(t)
        assert int(v["match_diffs"]) == d[s, e] == min(d.values()) == sum(int(v[f"match_{x}"]) for x in ("ins", "del", "subst"))
        assert e == min(y for (_, y), x in d.items() if x == d[s, e]) or (e - min(y for (_, y), x in d.items() if x == d[s, e])) <= 2 * d[s, e]
        assert v["match"] == t[s:e] == v["aligned_match"].replace("-", "") and v["aligned_pattern"].replace("-", "") == pattern and len(v["aligned_match"]) == len(v["aligned_pattern"])
        assert (v["match_len"], v["match_range"]) == (str(e - s), f"{s + 1}:{e}")
        assert (v["match_neg_start"], v["match_neg_end"], v["match_neg_range"]) == (str(s - n), str(e - n - 1), f"{s - n}:{e - n - 1}")
        assert float(v["match_diff_rate"]) == pytest.approx(d[s, e] / len(pattern), abs=1e-5) and (v["pattern_name"], v["pattern"], v["pattern_len"]) == ("one", pattern, str(len(pattern)))


def test_find_in_long_texts(spark):
    """Hits across the ends of the automaton's lanes, and a text of very many hits."""
    rng = random.Random(6)
    text = list("".join(rng.choices("CGT", k=3 * search.LANE + 100)))
    places = [0, search.LANE - 3, search.LANE + 2, 2 * search.LANE - 7, 3 * search.LANE + 20, len(text) - 8]
    for p in places:
        text[p : p + 8] = "AATAAGAA"
    se = search.Search(search.pattern_of("AATAACAA"), max_diffs=1)
    hits = search.find(make(spark, [("x", None, "".join(text)), ("y", None, "AC" * 20_000)]), se).collect()
    assert sorted(h["start"] for h in hits[0]["_m"][0]["hits"]) == places and not hits[1]["_hit"]
    exact = search.Search(search.pattern_of("AC"))
    found = search.find(make(spark, [("y", None, "AC" * 20_000)]), exact)
    assert len(found.first()["_m"][0]["hits"]) == 20_000
    assert search.replace_hits(found, exact, "{match_len}g").first()["seq"] == "2g" * 20_000


def find(spark, rows, pattern, fields, **k):
    se = search.Search(pattern if isinstance(pattern, tuple) else search.pattern_of(pattern), **k)
    return table(search.find(make(spark, rows), se), fields, search.find_context(se))


def test_find_exact_and_regex(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("AG", k=40)) for _ in range(20)] + ["", "C"]
    for t, got in zip(texts, find(spark, [("i", None, t) for t in texts], "AGAG", ["match_range(all)", "{match_start(-1)}"])):
        at = [m.start() for m in re.finditer("AGAG", t)]
        assert got == (",".join(f"{a + 1}:{a + 4}" for a in at) or "undefined") + "," + (str(at[-1] + 1) if at else "undefined")
    for t, got in zip(texts, find(spark, [("i", None, t) for t in texts], r"G(?<run>A+)(G|$)", ["match_group(run)", "match_group(2)", "match_grp_start(1)", "match_grp_end(1)", "match_grp_range(1)", "match_grp_neg_start(run)", "match_grp_neg_end(run)"], regex=True)):
        m = re.search(r"G(A+)(G|$)", t)
        want = [m.group(1), m.group(2), m.start(1) + 1, m.end(1), f"{m.start(1) + 1}:{m.end(1)}", m.start(1) - len(t), m.end(1) - len(t) - 1] if m else ["undefined"] * 7
        assert got == ",".join(map(str, want))


def test_find_options(spark):
    rows = [("a", None, "ttgaCCATgg"), ("b", None, "GGCCATTTCCAT"), ("c", None, None), ("d", None, "TTTTTTTT")]
    assert find(spark, rows, "CCAT", "match_start", ignore_case=True, max_diffs=0) == ["5", "3", "undefined", "undefined"]
    at = lambda **k: ids(search.matched(search.find(make(spark, rows), search.Search(search.pattern_of("CCAT"), **k))))
    assert (at(anchor_start=2), at(anchor_start=4), at(anchor_end=0), at(max_diffs=1, anchor_end=1)) == (["b"], ["a", "b"], ["b"], ["b"])
    assert find(spark, rows, "CCAT", "match_range(all)", max_rate=0.2499) == ["5:8", "3:6,9:12", "undefined", "undefined"]
    # of two patterns the one with fewer differences comes first
    two = (("p", "CCGT"), ("q", "TTTC"))
    assert find(spark, rows[1:2], two, "pattern_name,match_diffs,{pattern_name(2)}", max_diffs=1) == ["q,0,p"]
    # a hit whose alignment scores 0 is one nevertheless
    assert find(spark, [("z", None, "ACAC")], "ACGTAC", "match_range(all)", max_diffs=2) == ["1:4"]
    se = search.Search(search.pattern_of("CCAT"))
    assert [r["seq"] for r in search.replace_hits(search.find(make(spark, rows), se), se, "<{match_start}>").collect()] == ["ttga<5>gg", "GG<3>TT<3>", "", "TTTTTTTT"]
    assert [r["_hit"] for r in search.find(make(spark, rows), se).collect()] == [True, True, False, False]


def test_compare(spark):
    rng = random.Random(12)
    tables = [[(str(i), None, rng.choice(["AC", "GT", "CC"])) for i in rng.sample(range(40), 25)] for _ in range(2)]
    left, right = (make(spark, t, 2) for t in tables)
    for key, of in (("id", lambda r: r[0]), ("id,seqhash", lambda r: (r[0], r[2]))):
        a, b = ({of(r) for r in t} for t in tables)
        got = {r["category"]: r["n"] for r in keyed.compare_stats(left, right, key).collect()}
        assert got == {"common": len(a & b), "unique1": len(a - b), "unique2": len(b - a)}
        assert set(ids(keyed.intersect(left, right, key))) == {r[0] for r in tables[0] if of(r) in b}
        assert set(ids(keyed.difference(left, right, key))) == {r[0] for r in tables[0] if of(r) not in b}
    with pytest.raises(Exception, match="key occurs twice"):
        keyed.compare(left, right, "seq").collect()
    assert not keyed.is_equal(left, right) and keyed.is_equal(left, left)


def test_positional(spark):
    a, b = make(spark, READS[:2], 2), make(spark, [(i, d, "A") for i, d, _ in READS[:2]])
    assert [r["seq"] for r in keyed.interleave(a, b).orderBy("_ord").collect()] == [READS[0][2], "A", READS[1][2], "A"]
    assert keyed.concat(a, b, spacer=2).orderBy("_ord").first()["seq"] == READS[0][2] + "NNA"
    with pytest.raises(Exception, match="number of records"):
        keyed.concat(a, b.limit(1)).collect()


def test_meta_and_split(spark):
    meta = spark.createDataFrame([("m1", "x"), ("m1", "y"), ("m2", None)], "i string, v string")
    df, ctx = keyed.with_meta(make(spark, READS[:4]), meta)
    rows = sorted(table(df, "id,{has_meta()},{opt_meta(v)}", ctx))
    assert [r[:7] for r in rows] == ["m1,true", "m2,true", "m3,fals", "m4,fals"]
    assert sorted(ids(keyed.has_meta(make(spark, READS[:4]), meta, "i", "left_anti"))) == ["m3", "m4"]
    assert sorted(tuple(r) for r in keyed.split_counts(keyed.split_paths(make(spark, READS), "f{chunk}.fa", 4)).collect()) == [("f1.fa", 4), ("f2.fa", 2)]


def test_samples_and_slices(spark):
    df = make(spark, [(str(i), None, "A") for i in range(100)], 4)
    assert ids(basic.slice_records(df, 3, 5)) == ["2", "3", "4"]
    assert sorted(map(int, ids(basic.slice_records(df, 98, None)))) == [97, 98, 99]
    assert ids(basic.tail(df, 2)) == ["98", "99"]
    s = ids(basic.sample_n(df, 10, 1))
    assert len(s) == 10 and s == sorted(s, key=int) and s == ids(basic.sample_n(df, 10, 1))
    with pytest.raises(ValueError):
        basic.slice_records(df, 0, 3)


def score(x, y):
    """The score of an alignment, counted column by column."""
    total, gap = 0, None
    for p, q in zip(x, y):
        own = "x" if p == "-" else "y" if q == "-" else None
        total += (align.GAP_EXTEND + (align.GAP_OPEN if own != gap else 0)) if own else align.MATCH if p == q else align.MISMATCH
        gap = own
    return total


def test_alignment():
    def best(a, b):
        """The best score, over all ways of going on."""
        from functools import cache

        @cache
        def rest(i, j, gap):
            if i == len(a) and j == len(b):
                return 0
            ways = []
            if i < len(a) and j < len(b):
                ways.append((align.MATCH if a[i] == b[j] else align.MISMATCH) + rest(i + 1, j + 1, None))
            for own, di, dj in (("y", 1, 0), ("x", 0, 1)):
                if i + di <= len(a) and j + dj <= len(b):
                    ways.append(align.GAP_EXTEND + (align.GAP_OPEN if gap != own else 0) + rest(i + di, j + dj, own))
            return max(ways)

        return rest(0, 0, None)

    rng = random.Random(3)
    pairs = [("", ""), ("", "AC"), ("ACGT", ""), ("ACGT", "ACGT"), ("AACCGGTTAACCGGTT", "AACCGGTTCCGGTT"), ("é🧬A", "éA")]
    for _ in range(60):
        a = "".join(rng.choices("ACG", k=rng.randint(0, 14)))
        pairs.append((a, "".join(c for c in a if rng.random() < 0.8) + "".join(rng.choices("ACG", k=rng.randint(0, 9)))))
    for a, b in pairs:
        x, y = align.global_alignment(a, b)
        assert len(x) == len(y) and x.replace("-", "") == a and y.replace("-", "") == b and ("-", "-") not in zip(x, y)
        assert score(x, y) == best(a, b)
    x, y = align.global_alignment("ACGT" * 1000, "ACGT" * 990)
    assert len(x) == len(y) == 4000


def test_alignments_at_once(spark, monkeypatch):
    """Many pairs at once give what each gives on its own, and don't go one by one."""
    rng = random.Random(8)
    pairs = [("", ""), ("", "AC"), ("ACGT", ""), ("~-A", "-"), ("".join(map(chr, range(0x4E00, 0x4E50))), "丁七丈"), ("A" * 90, "A" * 7)]
    for _ in range(150):
        letters = rng.choice(["A", "AC", "ACGT", "é🧬Aß"])
        a = "".join(rng.choices(letters, k=rng.randint(0, 60)))
        b = "".join(c for c in a if rng.random() < 0.8) + "".join(rng.choices(letters, k=rng.choice([0, 3, 90])))
        pairs.append((a, b) if rng.random() < 0.5 else (b, a))
    one = align.global_alignment
    want = [one(a, b) for a, b in pairs]
    for lanes, cells in ((512, 10_000_000), (7, 10_000_000), (512, 20_000), (512, 400)):
        monkeypatch.setattr(align, "LANES", lanes)
        monkeypatch.setattr(align, "CELLS", cells)
        alone = []
        monkeypatch.setattr(align, "global_alignment", lambda a, b, alone=alone: alone.append((a, b)) or one(a, b))
        assert align.global_alignments(pairs) == want
        assert bool(alone) == (cells == 400) and len(alone) < len(pairs)
    assert align.global_alignments([]) == []
    df = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(pairs[6:30])] + [(None, "A", 97), ("A", None, 98), ("", "", 99)], "a string, b string, k int")
    got = df.select("k", align.aligned(F.col("a"), F.col("b")).alias("x")).orderBy("k").select("x.*").collect()
    assert [tuple(r) for r in got] == [*want[6:30], (None, None), (None, None), ("", "")]


def test_ranks_of_whole_tables(spark):
    rows = [(f"r{i}", None if i % 5 == 0 else f"p={i * 7 % 11}", "ACGT"[i * 3 % 4] * (i % 3)) for i in range(300)]
    df = make(spark, rows, 7)
    got = {r["id"]: r["_rank"] for r in basic.sort_ranks(df, "seq").collect()}
    want = sorted(range(300), key=lambda i: (rows[i][2], i))
    assert got == {f"r{i}": k + 1 for k, i in enumerate(want)}
    got = {r["id"]: r["_rank"] for r in basic.sort_ranks(df, "{num(opt_attr('p'))}", reverse=True).collect()}
    want = sorted(range(300), key=lambda i: (i % 5 != 0, -(i * 7 % 11) if i % 5 else 0, i))
    assert got == {f"r{i}": k + 1 for k, i in enumerate(want)}
    assert basic.sort_ranks(df.limit(0), "seq").collect() == []


def test_queries_of_whole_tables(spark, tmp_path):
    from strandframe.plans import record_queries

    spark.createDataFrame([(1, "ACGN-TR", "size=2;"), (2, "YA-NCGT", None), (3, "ACGU", "size=10;"), (4, "acgu", "x"), (5, None, None)], "amp_no bigint, seq string, descr string").write.parquet(str(tmp_path / "amplicons.parquet"))
    run = lambda n: {tuple(r) for r in record_queries.QUERIES[n](spark, str(tmp_path)).collect()}
    assert run("unique_strand_all") == {("1", 2), ("3", 2), ("5", 1)}
    assert run("concat_all") == {("1", "ACGN-TRNNNYA-NCGT", 1), ("2", "YA-NCGTNNNACGN-TR", 2), ("3", "ACGUNNNACGU", 3), ("4", "acguNNNacgu", 4), ("5", "NNN", 5)}
    assert run("sort_attr_all") == {("2", None, 1), ("4", None, 2), ("5", None, 3), ("3", 10.0, 4), ("1", 2.0, 5)}


def test_lists_longer_than_a_million(spark):
    n = (1 << 20) + 5
    u = spark.range(1).select(F.lit("a").alias("id"), F.concat(F.repeat(F.lit("a,"), n), F.lit("b")).alias("duplicates_list"), F.lit("").alias("key"), F.lit(n + 1).alias("n_duplicates"))
    got = basic.stat(u, ["duplicates_list(false)"], keyed.unique_context(), ["others"]).select(F.length("others"), F.substring("others", -1, 1)).first()
    assert tuple(got) == (2 * n - 1, "b")


def test_attributes_taken_out(spark):
    from strandframe.operators import basic as ops

    df = make(spark, [("s", "a=2 b=3", "ATGCA"), ("t", "a=1", "AC")])
    assert [(r["id"], r["desc"]) for r in ops.set_fields(df, id="{id}_{attr_del(a)}").collect()] == [("s_2", "b=3"), ("t_1", "")]
    assert [r["desc"] for r in ops.set_attrs(df, append={"c": "{opt_attr_del('b')}"}).collect()] == ["a=2 c=3", "a=1 c=undefined"]
    assert [(r["seq"], r["desc"]) for r in ops.trim(df, "{attr_del(a)}:").collect()] == [("TGCA", "b=3"), ("AC", "")]
    assert [(r["id"], r["desc"]) for r in ops.filter_records(df, "attr_del('a') > 1").collect()] == [("s", "b=3")]
    with pytest.raises(Exception, match="no attribute"):
        ops.set_fields(df, id="{attr_del(b)}").collect()


def test_scripts(spark, tmp_path):
    from strandframe.lang import script

    (tmp_path / "f.js").write_text("/* two */\nconst k = 2;\nfunction twice(x) { return x * k; }\nfunction kind(n, word) { if (twice(n) > 9) { return word + '}'; } else return 'no'; }")
    ctx = script.load(Context(), f"file:{tmp_path}/f.js")
    (tmp_path / "e.js").write_text("if (seqlen > 4) return 'big'; return 'small';")
    df = make(spark, [("s", None, "ATGCA"), ("t", None, "AC")])
    assert table(df, ["{kind(seqlen, 'yes')}", "{twice(seqlen)}", f"{{file:{tmp_path}/e.js}}"], ctx) == ["yes},10,big", "no,4,small"]
    for bad in ("x = 1;", "function f(a) { return a;", "1 + 1"):
        with pytest.raises(ExpressionError):
            script.define(Context(), bad)
    with pytest.raises(ExpressionError):
        table(df, ["{twice(1, 2)}"], ctx)


def test_view(spark):
    from strandframe import show

    df = make(spark, [("s", None, "ACGU-N"), ("t", None, "acgt" * 50)])
    text = show.view(df, width=10, color=False).split("\n")
    assert text[0].split() == ["s", "ACGU-N"] and text[1].endswith("acgtacgtac...")
    assert "38;5;71mA" in show.view(df) and show.view(df, palette="grey") != show.view(df)
    good = df.withColumn("qual", F.lit("IIIIII"))
    assert "48;5;46" in show.view(good, quality="sanger") and "38;5;160" in show.view(make(spark, [("p", None, "MDEL")]))


def test_keys_and_pattern_files(spark, tmp_path):
    df = make(spark, READS)
    x, ctx = basic.with_key(df, "seqlen,opt_attr(w)")
    assert table(x, "key", ctx)[0] == "14,7"
    got = keyed.compare(df, df.limit(3), "id").select("key", "category").collect()
    assert {r["key"]: r["category"] for r in got} == {r[0]: "common" if i < 3 else "unique1" for i, r in enumerate(READS)}
    (tmp_path / "p.fasta").write_text(">one first\nGATT\nACA\n>two\nCCGG\n")
    assert search.read_patterns(spark, f"file:{tmp_path}/p.fasta") == (("one", "GATTACA"), ("two", "CCGG"))
    assert search.read_patterns(spark, "ACG") == (("<pattern>", "ACG"),)
    (tmp_path / "none.fasta").write_text("")
    with pytest.raises(ExpressionError):
        search.read_patterns(spark, f"file:{tmp_path}/none.fasta")
