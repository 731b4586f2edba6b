import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandframe.llm import bitplanes, encode, format_copies, frequent, near_copies, packing, pii


def test_format_copies(spark):
    rows = [
        (1, "ACGT", "soil core tile=1 x=2"), (2, "ac-gt", "Soil  Core; X: 2; TILE := 1;"), (3, "ACGT", "core soil tile=1 x=2"), (4, "ACGT", None), (5, "", "soil"), (6, None, "soil"), (7, "ACG", "soil core tile=1 x=2"),
        (8, "A\nCGT", "(soil core) tile=1 tile=1 x='2'"), (9, "ACGT", "soil-core site=old quarry"), (10, "acgt", "soil_core site: Old  Quarry"), (11, "A" * 5000, "long"), (12, "a" * 5000, "LONG."), (None, "ACGT", "soil core tile=1 x=2"),
    ]
    df = spark.createDataFrame([(*r, "other") for r in rows], "rec_no bigint, seq string, descr string, canon string").repartition(3)
    want = {(1, 2), (1, 8), (9, 10), (11, 12)}
    for options in ({}, {"capacity": 1, "run_rows": 2}, {"capacity": 2, "run_rows": 1, "heavy": 0, "salts": 3}):
        got = format_copies.copies_found(df, **options).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert format_copies.copies_found(df.limit(0)).collect() == []


def test_format_copies_of_very_many_fields(spark):
    descr = F.concat(F.lit("soil"), F.repeat(F.lit(" x=1"), (1 << 20) + 5))
    df = spark.range(2).select(format_copies.canonical(F.lit("ACGT"), F.concat(descr, F.lit(" y="), F.col("id").cast("string"))).alias("c"))
    assert df.distinct().count() == 2


def test_trie_counts():
    words = [b"", b"a", b"a" * 24, b"a" * 25, b"a" * 48, b"ab", b"a"]
    trie = format_copies.Trie()
    for w in words:
        trie.terminal(w)[1] += 1
    assert {k: t[1] for k, t in trie.terminals()} == dict(Counter(words))


def test_frequent(spark):
    df = spark.createDataFrame([(x,) for x in ["a"] * 5 + ["A"] * 3 + [""] * 2 + [None] * 90], "seq string")
    assert {r["value"] for r in frequent.frequent_values(df, "seq", 0.3).collect()} == {"a", "A"}
    assert [tuple(r) for r in frequent.top_values(df, "seq", 2).collect()] == [("a", 5), ("A", 3)]
    assert frequent.frequent_values(df.limit(0), "seq", 0.3).collect() == []


def brute(rows, k, t):
    sets = {i: {x[j : j + k] for j in range(len(x) - k + 1)} for i, x in rows if x and len(x) >= k}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def test_near_copies(spark):
    rng = random.Random(5)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    primer, rows = dna(20), []
    for _ in range(40):
        base = primer + dna(rng.choice([30, 90, 250])) + primer
        for _ in range(rng.choice([1, 1, 2, 5])):
            s = list(base)
            for _ in range(rng.randint(0, 6)):
                s[rng.randrange(len(s))] = rng.choice(["", "A", "GG", "N"])
            rows.append("".join(s))
    rows += [rows[0].lower(), rows[0], "ACGTACG", "", None, "N" * 300, "N" * 400, "é" * 9 + dna(20), dna(3000)]
    table = list(enumerate(rows))
    df = spark.createDataFrame([(i, x, "z") for i, x in table], "amp_no bigint, seq string, tokens string").repartition(3)
    want = brute([(i, x.upper() if x else x) for i, x in table], 8, 0.6)
    got = near_copies.near_pairs(df, "amp_no", "seq").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want
    classes = {r["amp_no"]: r["class_id"] for r in near_copies.near_classes(df, "amp_no", "seq").collect()}
    assert all(classes[a] == classes[b] for a, b in want) and len(classes) == sum(len(x or "") >= 8 for x in rows)
    assert near_copies.near_pairs(df.limit(0), "amp_no", "seq").collect() == []


def test_common_windows_are_those_of_the_whole_table(spark):
    rng = random.Random(9)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    base, rows = dna(290), []
    for i in range(210):
        s = list(base)
        for at in rng.sample(range(290), rng.choice([2, 4])):
            s[at] = rng.choice("ACGT")
        rows.append((i, "".join(s)))
    rows += [(i, dna(290)) for i in range(210, 630)]
    # the family is common in the first partition, rare in the second
    parts = [rows[:180] + rows[210:570], rows[180:210] + rows[570:]]
    df = spark.createDataFrame(spark.sparkContext.parallelize(parts, 2).flatMap(lambda x: x), "amp_no bigint, seq string")
    got = {tuple(r) for r in near_copies.near_pairs(df, "amp_no", "seq").collect()}
    want = brute(rows[:210], 8, 0.6)
    assert (len(got & want), len(got - want)) == (len(want), 0)


def packed(texts):
    (b,) = near_copies._pack([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([b""] * len(texts)), pa.array(texts)], names=["id", "digest", "text"])])
    return b.select(["packed", "text", "n"])


def sketched(texts, width=16, common=None):
    sizes = [near_copies.sketch_size(x / 100, 8, 0.6, width) for x in range(101)]
    return near_copies.sketches(packed(texts), np.zeros(near_copies.PARTS, bool) if common is None else common, width, 8, sizes)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ACGTNé🧬", min_size=1, max_size=30), min_size=1, max_size=9))
def test_packed_texts(texts):
    b = packed(texts)
    for part in (b, b.slice(len(texts) // 2)):
        cp, first, n = near_copies._letters(*part.columns)
        assert ["".join(map(chr, cp[a : a + m])) for a, m in zip(first, n)] == texts[len(texts) - len(part) :]


def test_sketches_of_repeats():
    rng = random.Random(3)
    tail = "".join(rng.choices("ACGT", k=230))
    tokens, bands = sketched(["A" * 60 + tail, tail, "ACG" * 100])
    a, b, c = (set(t.tolist()) for t in tokens)
    assert len(a) == len(b) == near_copies.SKETCH and len(a & b) > 15 and len(c) == 3
    assert [x is None for x in bands] == [True, True, False]


def test_a_sketch_does_not_depend_on_its_batch():
    rng = random.Random(8)
    texts = ["".join(rng.choices("ACGT", k=rng.choice([20, 150, 300]))) for _ in range(50)]
    common = np.random.default_rng(1).random(near_copies.PARTS) < 0.02
    together, one = sketched(texts, 17, common), [sketched([t], 17, common) for t in texts]
    for i in range(50):
        assert together[0][i].tolist() == one[i][0][0].tolist() and (together[1][i] is None) == (one[i][1][0] is None)


@pytest.mark.parametrize(("n", "size"), [(12_000, 300), (3_000, 2_000)])
def test_unrelated_records_stay_apart(n, size):
    letters = np.frombuffer(b"ACGT", np.uint8)[np.random.default_rng(size).integers(0, 4, (n, size))]
    tokens, bands = sketched([x.tobytes().decode() for x in letters], near_copies.window_width(n * size))
    assert all(x is None for x in bands)
    owners: dict = {}
    for i, t in enumerate(tokens):
        for x in t.tolist():
            owners.setdefault(x, []).append(i)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for group in owners.values():
        for y in group[1:]:
            parent[find(y)] = find(group[0])
    parts = Counter(find(i) for i in range(n))
    assert max(parts.values()) <= 8 and len(parts) > 0.9 * n


@pytest.mark.parametrize("size", [300, 600, 2000, 5000])
def test_planes_abandon_unrelated_sets(size):
    rng = np.random.default_rng(size)
    sets = [np.unique(rng.integers(0, 1 << 60, size, dtype=np.uint64)) for _ in range(120)]
    count = np.array([len(s) for s in sets])
    bits = bitplanes.parities(np.repeat(np.arange(120), count), np.concatenate(sets), 120, bitplanes.planes_for(count))
    assert not len(bitplanes.within(bits, bits, np.triu(np.ones((120, 120), bool), 1), count, count, 0.25)[0])


def test_links_by_values_too_common_for_a_star(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "COMMON_TOTAL", 1)
    rng = random.Random(4)
    rows, want = [], set()
    for g in range(0, 1600, 2):
        base = "".join(rng.choices("ACGT", k=290))
        for i in range(2):
            s = list(base)
            for at in range(28 + 32 * i, 290, 64):
                s[at] = "ACGT"["TGCA".index(s[at])]
            rows.append((g + i, "".join(s)))
        want |= brute(rows[-2:], 8, 0.6)
    got = {tuple(r) for r in near_copies.near_pairs(spark.createDataFrame(rows, "amp_no bigint, seq string"), "amp_no", "seq").collect()}
    assert (len(got & want), len(got - want)) == (len(want), 0)


def test_a_band_of_very_many_records(spark, monkeypatch):
    # all records share their only windows, so each task combines their bands before they are sent
    monkeypatch.setattr(near_copies, "CHUNK", 40)
    rows = [(i, "ACGTTGCAAC" + "N" * (30 + i)) for i in range(300)]
    df = spark.createDataFrame(rows, "amp_no bigint, seq string").repartition(4)
    want = brute(rows, 8, 0.6)
    assert {tuple(r) for r in near_copies.near_pairs(df, "amp_no", "seq").collect()} == want
    classes = near_copies.near_classes(df, "amp_no", "seq").collect()
    assert {r["class_id"] for r in classes} == {0} and sum(r["n_links"] for r in classes) == 2 * len(want)


def test_pairs_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    rng = random.Random(11)
    text = "".join(rng.choices("ACGT", k=100))
    df = spark.createDataFrame([(i, text) for i in range(100)], "amp_no bigint, seq string")
    got = [tuple(r) for r in near_copies.near_pairs(df, "amp_no", "seq").collect()]
    assert sorted(got) == list(combinations(range(100), 2))


def test_links_of_short_texts_with_other_characters(spark):
    rng = random.Random(6)
    rows = []
    for i in range(0, 40, 2):
        text = "".join(rng.choices("ACGT", k=14))
        rows += [(i, text), (i + 1, text + "\u2013")]
    got = {tuple(r) for r in near_copies.near_pairs(spark.createDataFrame(rows, "amp_no bigint, seq string"), "amp_no", "seq").collect()}
    want = brute(rows, 8, 0.6)
    assert (len(got & want), len(got - want)) == (len(want), 0) and len(want) >= 20


def test_large_components_are_cut_into_blocks(spark, monkeypatch):
    rng = random.Random(7)
    base = "".join(rng.choices("ACGT", k=150))
    rows = [(i, base[: 60 + i % 40] + "ACGT"[i % 4] * (i % 3) + base[60 + i % 40 :]) for i in range(60)]
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    df = spark.createDataFrame(rows, "amp_no bigint, seq string")
    got = {tuple(r) for r in near_copies.near_pairs(df, "amp_no", "seq").collect()}
    assert got == brute(rows, 8, 0.6)


def test_sketches_suffice_in_large_tables():
    # texts with shared ends, windows as wide as 6 GB of such texts make them
    rng = random.Random(12)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    ends = dna(20), dna(20)
    texts = [ends[0] + dna(n) + ends[1] for n in range(110, 400, 5)]
    common = np.zeros(near_copies.PARTS, bool)
    for e in ends:
        common[near_copies._parts(near_copies._two_bits(np.frombuffer(e.encode(), np.uint8), near_copies.PART)[0][: 21 - near_copies.PART])] = True
    common |= np.random.default_rng(2).random(near_copies.PARTS) < 0.004  # places that other shared parts take
    tokens, bands = sketched(texts, near_copies.window_width(11_300_000_000), common)
    assert sum(x is not None for x in bands) < 3 and np.mean([len(t) for t in tokens]) < 80


def test_chunks_are_small_and_whole():
    rng = np.random.default_rng(5)
    ids = np.concatenate([np.arange(20_000), (3 << 33) + np.arange(20_000)])
    values, owners = rng.integers(0, 1 << 62, 40 * len(ids), dtype=np.uint64), np.repeat(ids, 40)
    chunks = near_copies._Chunks(12, 37)
    chunks.add(near_copies.SKETCHES, values, owners)
    chunks.own.append(ids)
    out = chunks.flush().to_pylist()
    assert sum(len(x["tokens"]) + len(x["ids"]) for x in out) < 6 * len(owners)
    got = [(t, i) for x in out for t, i in zip((np.cumsum(near_copies._of_planes(x["tokens"][8:], x["n"])) + np.frombuffer(x["tokens"], np.uint64, 1)).tolist(), near_copies._of_runs(x["ids"], x["n"]).tolist())]
    assert sorted(got) == sorted(zip((values * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(27)).tolist(), owners.tolist()))


def test_chance_joins_no_components(spark, monkeypatch):
    # windows so narrow that most texts share one with an unrelated text
    monkeypatch.setattr(near_copies, "window_width", lambda letters: 11)
    sizes, whole = [], near_copies.components

    def components(edges):
        out = whole(edges)
        sizes.append(max(Counter(r["component"] for r in out.collect()).values()))
        return out

    monkeypatch.setattr(near_copies, "components", components)
    rng = random.Random(14)
    rows = [(i, "".join(rng.choices("ACGT", k=300))) for i in range(3000)]
    rows += [(3000 + i, s[: 40 + i] + "A" + s[41 + i :]) for i, s in rows[:100]]
    got = {tuple(r) for r in near_copies.near_pairs(spark.createDataFrame(rows, "amp_no bigint, seq string"), "amp_no", "seq").collect()}
    assert got == {(i, 3000 + i) for i in range(100)}
    assert max(sizes) < 200


def test_pairs_of_one_value_are_compared(spark, monkeypatch):
    # each text of a pair shares few of its windows, so many pairs have no more than one value in common
    monkeypatch.setattr(near_copies, "sketch_size", lambda *a: 8)
    monkeypatch.setattr(near_copies, "window_width", lambda letters: 20)
    rng = random.Random(15)
    rows = []
    for g in range(0, 400, 2):
        base = "".join(rng.choices("ACGT", k=290))
        s = list(base)
        for at in range(28, 290, 30):
            s[at] = "ACGT"["TGCA".index(s[at])]
        rows += [(g, base), (g + 1, "".join(s))]
    tokens, _ = sketched([s for _, s in rows], 20)  # of 8 values
    shared = [len(set(a.tolist()) & set(b.tolist())) for a, b in zip(tokens[::2], tokens[1::2])]
    want = {(2 * g, 2 * g + 1) for g, n in enumerate(shared) if n and brute(rows[2 * g : 2 * g + 2], 8, 0.6)}
    got = {tuple(r) for r in near_copies.near_pairs(spark.createDataFrame(rows, "amp_no bigint, seq string"), "amp_no", "seq").collect()}
    assert got == want and shared.count(1) > 5


def test_bit_planes_lose_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 40, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, n, replace=False), rng.integers(0, 1 << 40, m, dtype=np.uint64)])) for n, m in ((200, 0), (190, 5), (150, 60), (100, 200), (20, 200), (200, 40))]
    size = np.array([len(s) for s in sets])
    bits = bitplanes.parities(np.repeat(np.arange(len(sets)), size), np.concatenate(sets), len(sets))
    wanted = np.triu(np.ones((6, 6), bool), 1)
    got = set(zip(*(x.tolist() for x in bitplanes.within(bits, bits, wanted, size, size, 0.25))))
    need = {(i, j) for i, j in combinations(range(6), 2) if len(np.setxor1d(sets[i], sets[j])) <= 0.25 * (size[i] + size[j])}
    assert need <= got and (3, 4) not in got


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.TOKENIZER)
    t.encode_special_tokens = True
    return t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="' \n\t  's're'llve t9é中🧬<|endoftext|>-x", max_size=40), min_size=1, max_size=20))
def test_encode_against_library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.TOKENIZER)
    t.encode_special_tokens = True
    coder = encode.Encoder.of(encode.TOKENIZER)
    offsets, ids = coder.encode(texts)
    got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert encode.decode(encode.TOKENIZER, got) == texts


def test_long_words(library):
    rng = random.Random(4)
    coder = encode.Encoder.of(encode.TOKENIZER)
    words = ["a" * n for n in (1, 2, 3, 513, 514, 515, 2047)] + ["".join(rng.choices("abcdefgh", k=3000)), "".join(rng.choices("ACGT", k=20_000)), "=-" * 700, "é" * 600, "ab" * 2000 + "b" * 999]
    for w in words:
        assert coder.contract(w.encode()).tolist() == library.encode(w, add_special_tokens=False).ids
    offsets, ids = coder.encode(words)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_encode_frame(spark, library):
    texts = ["", None, "Hello <|endoftext|> world's", "x" * 3000, " " * 700, "a b " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    got = {r["doc_id"]: r["ids"] for r in encode.encode(df).collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_ids"] for r in encode.count_ids(df).collect()} == {i: len(x) for i, x in got.items()}
    assert encode.encode(df.limit(0)).collect() == []


def check_packing(rows, sizes, capacity):
    parts = Counter()
    where = {}
    for doc, part, box, at, n in rows:
        parts[doc] += n
        assert n <= capacity and (doc, part) not in where
        where[doc, part] = (box, at, n)
    assert parts == Counter({d: n for d, n in sizes if n})
    assert all(sum(d == doc for d, _ in where) == 1 for doc, n in sizes if 0 < n <= capacity)
    boxes: dict = {}
    for box, at, n in where.values():
        boxes.setdefault(box, []).append((at, n))
    for items in boxes.values():
        end = 0
        for at, n in sorted(items):
            assert at == end
            end = at + n
        assert end <= capacity
    assert sorted(boxes) == list(range(len(boxes)))
    return len(boxes)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=20))
def test_plan(counts):
    plan = packing.Plan(counts, 50)
    sizes, rows, doc = [], [], 0
    runs = sorted(plan.runs)
    for size, n in counts.items():
        own = [r for r in runs if r[0] == size]
        for rank in range(n):
            _, first, box, at, each = [r for r in own if r[1] <= rank][-1]
            k = rank - first
            rows.append((doc, 0, box + k // each, at + k % each * size, size))
            sizes.append((doc, size))
            doc += 1
    assert check_packing(rows, sizes, 50) == plan.containers


def test_pack_frame(spark):
    rng = random.Random(2)
    sizes = [(i, rng.choice([7, 7, 7, 3, 20, 34, 50, 100, 120, 0, 49])) for i in range(400)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_ids bigint").repartition(3)
    rows = [tuple(r) for r in packing.pack_sizes(df, "doc_id", 50).collect()]
    n = check_packing(rows, sizes, 50)
    assert n <= 1.05 * -(-sum(s for _, s in sizes) // 50)
    assert packing.pack_sizes(df.limit(0), "doc_id", 50).collect() == []


TEXT = "Author: Odalyn K. Marker <odalyn.marker@x.example.org>\\nwritten by Zerina Peak, phone +44 20 7946 0994, ext. 3\nowner: Zerina Peak; street: 12b Old Weir Road; SSN 912-00-7003\nTicket 125-20-4203: pip install seqtable@2.2.9; reed beds. mail pavlik dot reed at lab dot x dot example now"


def test_pii_forms():
    got = {(k, x) for k, _, _, x, *_, seed in pii.candidates(TEXT) if seed or k == "person_name"}
    assert {("email", "odalyn.marker@x.example.org"), ("email", "pavlik dot reed at lab dot x dot example"), ("phone", "+44 20 7946 0994"), ("street_address", "12b Old Weir Road"), ("id_number", "912-00-7003"), ("person_name", "Odalyn K. Marker"), ("person_name", "Zerina Peak")} <= got
    assert not any(x in ("125-20-4203", "seqtable@2.2.9") for _, x in got)


def test_pii_learns_unseen_names(spark):
    known, unseen = ["Zerina", "Pavlik", "Merrol"], ["Yorrin", "Nuvia"]
    rows = [(i, f"written by {g} {f}.") for i, (g, f) in enumerate((g, f) for g in known + unseen for f in ("Peak", "Vantessy", "Aldermoor"))]
    rows += [(100, "Read Table and Next Cell"), (101, None), (102, ""), (103, "x" * 300_000), (104, TEXT)]
    parts = spark.createDataFrame([(n, "given") for n in known] + [("Peak", "family"), ("vantessy", "family"), (None, "family")], "name_part string, part_kind string")
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    spans = pii.find_pii(df, parts)
    got = {(r["doc_id"], r["pii_text"]) for r in spans.collect()}
    assert {(i, t[11:-1]) for i, t in rows[:15]} <= got and not any(i == 100 for i, _ in got)
    text = {r["doc_id"]: r["text"] for r in pii.redact(df, spans).collect()}
    assert text[0] == "written by [PERSON_NAME]." and text[101] is None and text[102] == "" and len(text[103]) == 300_000
    assert "[EMAIL]" in text[104] and "[STREET_ADDRESS]" in text[104] and "Ticket 125-20-4203" in text[104]
    assert pii.find_pii(df.limit(0), parts).collect() == []


PROBES = {
    "id_number": ["employee badge number is QX-44-918-ZZ7.", "driving licence number: AB123456 is valid", "NINO no QQ 12 34 56 C appears"],
    "email": ["Автор: ivan.petrov@пример.рф", "mail " + "a" * 300 + "@x.example.org now", "mail " + "b" * 200 + " dot c at lab dot " + "d" * 150 + " dot example now"],
    "person_name": ["Автор: Иван Петров, лаборатория", "作成者: 山田 太郎", "by Odalyn K. O'Brannoch."],
    "street_address": ["lives at Via Roma 12, Milano", "in 12 " + "Q" + "q" * 90 + " Road today"],
}


def test_pii_probes():
    want = {
        "id_number": ["QX-44-918-ZZ7", "AB123456", "QQ 12 34 56 C"], "email": ["ivan.petrov@пример.рф", "a" * 300 + "@x.example.org", "b" * 200 + " dot c at lab dot " + "d" * 150 + " dot example"],
        "person_name": ["Иван Петров", "山田 太郎", "Odalyn K. O'Brannoch"], "street_address": ["Via Roma 12", "12 Q" + "q" * 90 + " Road"],
    }
    for kind, texts in PROBES.items():
        for text, piece in zip(texts, want[kind]):
            assert piece in [c[3] for c in pii.candidates(text) if c[0] == kind]


def test_pii_patterns_find_what_no_form_knows(spark):
    """Wide candidates are accepted where known ones stand in the same words, and only there."""
    rows = [f"please send it to {n} Kestrel Street in town" for n in range(5)] + ["please send it to Via Roma 12 in town", "the limit was Tafel Alt 12 at last"]
    rows += [f"reach me on +44 20 7946 09{n} after noon" for n in range(10, 16)] + ["reach me on 020.7946.0999 after noon", "unit 301.555.0147 belongs here"]
    rows += [f"holder has passport ZZ61901{n} on file" for n in range(10, 15)] + ["holder has QX-44-918-ZZ7 on file", "lot AB-44-918-ZZ7 expired", "holder has passport QX-44-918-ZZ8 on file", "seen QX-44-918-ZZ8 again"]
    rows += [f"notes of Zerina {f}, late" for f in ("Peak", "Stone", "Marsh")] * 8 + ["notes of Иван Петров, late", "plots of Иван Петров, late"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(3)
    parts = spark.createDataFrame([("Zerina", "given"), ("Peak", "family"), ("Stone", "family"), ("Marsh", "family")], "name_part string, part_kind string")
    got = {(r["doc_id"], r["pii_text"]) for r in pii.find_pii(df, parts).collect()}
    at = lambda text: rows.index(text)
    assert (at("please send it to Via Roma 12 in town"), "Via Roma 12") in got and at("the limit was Tafel Alt 12 at last") not in {d for d, _ in got}
    assert (at("reach me on 020.7946.0999 after noon"), "020.7946.0999") in got and at("unit 301.555.0147 belongs here") not in {d for d, _ in got}
    assert (at("seen QX-44-918-ZZ8 again"), "QX-44-918-ZZ8") in got and at("lot AB-44-918-ZZ7 expired") not in {d for d, _ in got}


def test_spans_that_overlap():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 1, 1, 2]), pa.array(["a"] * 5), pa.array([0, 3, 8, 9, 0], pa.int32()), pa.array([5, 8, 12, 10, 3], pa.int32()), pa.array(["x"] * 5), pa.array([3, 3, 2, 2, 1])], names=["doc_id", "pii_type", "s", "e", "pii_text", "rank"])
    (got,) = pii._apart([batch])
    assert list(zip(*(got[c].to_pylist() for c in ("doc_id", "s", "e")))) == [(1, 0, 5), (1, 8, 12), (2, 0, 3)]
    span = lambda kind, s, e: {"pii_type": kind, "s": s, "e": e}
    (out,) = pii._cover([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["abcdefghij"]), pa.array([[span("phone", 3, 8), span("person_name", 0, 4)]])], names=["doc_id", "text", "spans"])])
    assert out.column(1).to_pylist() == ["[PHONE]ij"]
    assert pii.united([span("email", 1, 3), span("phone", 3, 5)]) == [(1, 3, "email"), (3, 5, "phone")]


def test_components_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "FOREST", 16)
    rng = random.Random(13)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(3)
    got = {r["id"]: r["component"] for r in near_copies.components(df).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(500):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: p for x, p in parent.items() if any(x in e and e[0] != e[1] for e in edges)}
    monkeypatch.undo()
    assert {r["id"]: r["component"] for r in near_copies.components(df).collect()} == got
    assert near_copies.components(df.limit(0)).collect() == []
