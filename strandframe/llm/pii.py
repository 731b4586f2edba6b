"""Personal information in free text, by bootstrapped contextual extraction.

One pass over the texts writes candidates: spans that may be an e-mail address, phone
number, identity number, street address or person's name, each with its lexical pattern (the words around it; the same
with capitalised words as one class is its frame) and, where its form leaves no doubt, a seed mark. The rest works on the graph of
patterns and instances, for all types, in ``rounds`` rounds of groupBy and join: instances that are seeds or became known
give their patterns a score, the share of what stands in the pattern that is known; what stands mostly in patterns of
high score becomes known. Of names the instances are their parts, and the seeds are the kept list. A span is accepted if its
instance is known; a name if both parts are and its pattern isn't a poor one, or one is and its pattern is good, or its pattern
is nearly always a name's. Where accepted spans overlap, the surer one stays, then the longer one.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[STREET_ADDRESS]", "person_name": "[PERSON_NAME]"}

UP, LOW = "A-ZÀ-ÖØ-ÞĆČĐŁŃŚŠŹŻŽΑ-ΩА-ЯЁ", "a-zß-öø-ÿćčđłńřśšźżžά-ώа-яё"
WORD = rf"(?:[{UP}]['’][{UP}][{LOW}]+|[{UP}][{LOW}]+|[{UP}]{{2,}})(?:[-'’](?:[{UP}]?[{LOW}]+|[{UP}]+))*"
CAPS_O = rf"[{UP}]['’][{UP}]{{2,}}"
REST = rf"(?:['’][{UP}](?:[{LOW}]+|[{UP}]+)|[{LOW}]+|[{UP}]+)(?:[-'’](?:[{UP}]?[{LOW}]+|[{UP}]+))*"
# expressions begin with a set of characters, as these are found fastest; the look-behind holds that character too
NAME = re.compile(rf"[{UP}](?<![\w@./\\'’-].)(?=(?:(?P<g>{REST}|\.)(?: [{UP}]\.)? (?P<f>{CAPS_O}|{WORD})|(?P<f2>{REST}), (?P<g2>{WORD}|[{UP}]\.)(?: [{UP}]\.)?)(?![\w@]))")
#: Family and given name in Japanese, parted by a blank.
NAME_JA = re.compile(r"(?<![一-龯々ぁ-んァ-ヶー])(?P<f>[一-龯々]{1,4})[ \u3000](?P<g>[一-龯々]{1,4}|[ぁ-ん]{2,5}|[ァ-ヶー]{2,6})(?![一-龯々ぁ-んァ-ヶー])")
#: Titles, which aren't part of a name.
TITLES = {"Dr", "Prof", "Mr", "Mrs", "Ms", "Miss", "Herr", "Frau", "Mme", "Mlle", "Sr", "Sra", "Dra", "Don", "Dona", "Doña", "Sir", "Professor", "Doctor", "DR", "PROF"}

AT = re.compile(r"@|\s?[\[({]\s?(?:at|@)\s?[\])}]\s?| at (?=[\w-]+(?: dot |\.)[\w-])", re.I)
DOT = r"(?:\.|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?| dot )"
LOCAL = re.compile(rf"[\w+-]+(?:{DOT}[\w+-]+)*$", re.I)
DOMAIN = re.compile(rf"[\w-]+(?:{DOT}[\w-]+)*{DOT}(?:[^\W\d_]{{2,24}})(?![\w-])", re.I)

PHONE_START = re.compile(r"[+(\d](?<![\w.,+/:#=-].)(?=[\d ()./-]{7})")
ID_START = re.compile(r"[A-Z\d](?<![\w.,+/:#=-].)(?=[A-Z]{0,3}(?:[ -]?[\d .-]{6}|-[\dA-Z]{2}))")
PLAIN_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,24}(?![\w-])")

PHONE = re.compile(
    r"(?<![\w.,+/:#=-])(?:"
    r"(?P<s>\+\d{1,3}(?:[ .-]?\(0\))?(?:[ .-]?\d{1,5}){2,6}(?:/\d{2,5})?|00[1-9]\d(?:[ .-]\d{1,6}){2,5}|\(0\d{1,5}\) ?\d{3,8}(?:[ /-]\d{2,6}){0,2}|\(\d{3}\) ?\d{3}[ -]\d{4}"
    r"|0\d{2,5} ?/ ?\d{3,8}(?:-\d{1,5})?)"
    r"|(?P<w>0\d(?:[ .]\d\d){4}|0\d{4} ?\d{6}|0\d{4} \d{3} \d{3}|0\d\d \d{4} \d{4}|0\d{3} \d{3} \d{4}|0\d \d{4} \d{4}|0\d{3} \d{6,8}|\d{3}([-. ])\d{3}\3\d{4}|0[1-9]\d{8,9}|\d{2,4}([-.])\d{2,4}(?:\4\d{2,4}){1,3})"
    r")(?![\w]|[./-]\d)"
)

#: Labels that name a number of a person's document, tax or insurance.
ID_LABEL = re.compile(
    r"(?i)(?<![\w])(?:passport|pasaporte|passeport|reisepass|ssn|social security|national insurance|nino\b|ni (?=number|no)|tax id|tin\b|nif\b|nie\b|dni\b|steuer-?id|identity card|id card|national id|personalausweis|ausweis|sozialversicherung|rentenversicherung|"
    r"driv(?:er|ing)(?:'?s)? licen[cs]e|s[ée]curit[ée] sociale|insee|codice fiscale|снилс|инн\b|паспорт)[\w.º°’'-]*(?: (?:number|num|nummer|nr|no|n)\b[.º°]*)?(?: ?n\.º)?"
)
ID_VALUE = re.compile(r"(?:\s?[:=]\s?|\s?(?:is|ist|est|es)\s|\s?no\.?\s|\s?n\.º:?\s|\s)\(?(?P<v>[A-Z]{0,4}[ -]?\d[\dA-Z]*(?:[ .-][\dA-Z]+){0,5}|[A-Z]{2,4}-\d{6,10})")
#: What can't end a number: a word that follows it.
ID_TAIL = re.compile(r"(?:[ .-](?:[A-Z]{2,}|[A-Z](?=[a-z])))+$")
ID_SHAPE = re.compile(r"(?<![\w.,+/:#=-])(?:\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|\d{2}\.?\d{3}\.?\d{3}-?[A-Z]|\d{2} \d{3} \d{3} \d{3}|[A-Z]{2} ?\d{7}|[A-Z]{1,3}-?\d{8,9}|[A-Z]{1,4}(?:-[\dA-Z]{2,8}){2,5})(?![\w]|[./-]\d)")

STREET_EN = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Close|Drive|Dr|Row|Blvd|Boulevard|Way|Terrace|Court|Ct|Square|Sq|Place|Crescent|Hill|Gardens|Park|Grove|Walk|Mews|Quay|Wharf|Green|Alley|Parade|Rise|View)"
STREET = re.compile(
    r"(?<![\w/.#-])(?:"
    rf"\d{{1,4}} ?(?:[a-dA-D](?= ))?,? (?:(?:St|Old|New|Upper|Lower)\.? )?(?:[{UP}][\w'’-]* ){{1,3}}{STREET_EN}(?![\w-])"
    rf"|\d{{1,4}} ?(?:[a-dA-D](?=[ ,]))?(?: ?(?:bis|ter|quater)\b)?,? (?:rue|avenue|quai|impasse|chemin|all[ée]e|place|boulevard|cours|route|sentier|passage|square|ruelle)(?: (?:de la|du|des|de l['’]|de|d['’]|aux?))?(?: ?[{UP}][\w'’-]*){{1,3}}"
    rf"|(?:(?:Am|An der|An den|Auf dem|Auf der|Im|In der|Zum|Zur|Unter den|Hinter der) (?:[{UP}][\w-]* ?){{1,2}}|(?:[{UP}][\w-]* )?[{UP}][{LOW}ß-]*(?:stra(?:ß|ss)e|str\.|weg|platz|gasse|allee|ufer|ring|damm|steig|pfad|graben|markt)|[{UP}][\w-]* (?:Straße|Strasse|Str\.|Weg|Platz|Gasse|Allee|Ufer|Ring|Damm)) ?\d{{1,4}} ?(?:[a-d](?![\w]))?"
    rf"|(?:C/|Calle|Avda\.|Av\.|Avenida|Paseo|P\.º|Plaza|Pza\.|Camino|Ronda|Traves[ií]a|Carretera|Cuesta)(?: (?:de las|de los|de la|del|de))?(?: [{UP}][\w'’-]*){{1,3}},? ?(?:n\.º ?|núm\. ?|n[.º°]+ ?)?\d{{1,4}} ?(?:[a-d](?![\w]))?"
    r")"
)

#: Words with a house number that no form of STREET knows.
WIDE_STREET = re.compile(rf"[{UP}](?<![\w@./\\'’-].)(?=[{LOW}]+(?: [{UP}][\w'’-]*){{1,2}},? (?P<n>\d{{1,4}} ?(?:[a-d](?!\w))?)(?![\w.,:/-]\d|\w))")

#: Words near which the slower expressions are tried; one automaton finds all of them in a single pass.
NEAR = {
    "email": ("@", "(at", "[at", "{at", "( at", "[ at", "{ at", " at "),
    "id_number": (
        "passport", "pasaporte", "passeport", "reisepass", "ssn", "social security", "national insurance", "ni number", "ni no", "nino", "tax id", "tin ", "tin:", "nif", "nie ", "nie:", "dni", "steuer-id", "steuerid", "identity card", "id card", "national id",
        "ausweis", "sozialversicherung", "rentenversicherung", "driver", "driving", "sécurité sociale", "securite sociale", "insee", "codice fiscale", "снилс", "инн", "паспорт",
    ),
    "en": tuple(f" {w.lower()}" for w in STREET_EN[3:-1].split("|")),
    "fr": ("rue ", "avenue ", "quai ", "impasse ", "chemin ", "allée ", "allee ", "place ", "boulevard ", "cours ", "route ", "sentier ", "passage ", "square ", "ruelle "),
    "de": ("straße", "strasse", "str.", "weg", "platz", "gasse", "allee", "ufer", "ring", "damm", "steig", "pfad", "graben", "markt"),
    "am": ("am ", "an der ", "an den ", "auf dem ", "auf der ", "im ", "in der ", "zum ", "zur ", "unter den ", "hinter der "),
    "es": ("c/ ", "calle ", "avda.", "av. ", "avenida ", "paseo ", "p.º ", "plaza ", "pza. ", "camino ", "ronda ", "travesía ", "travesia ", "carretera ", "cuesta "),
}
TOKEN = re.compile(r"\w+|[^\w\s]")
MAIL_NEXT = re.compile(r"[ \t,;<(]*[\w.+-]+@")
CANDIDATE = "doc_id bigint, pii_type string, s int, e int, pii_text string, part_a string, part_b string, pattern string, frame string, seed boolean"


def plain(text: str) -> str:
    """The text with escaped line ends and tabs as blanks, every character in its place."""
    return text.replace("\\n", " \n").replace("\\r", "  ").replace("\\t", "  ") if "\\" in text else text


def pattern_of(text: str, s: int, e: int) -> tuple[str, str]:
    """The two words or signs before a span and the one after it, within its line, numbers as 0; and the same with capitalised words, and addresses, as one class."""
    reach = 40
    while True:  # words of any length
        left = text[max(0, s - reach) : s].rpartition("\n")[2]
        a = [t for t in TOKEN.findall(left) if t not in "#>\"'\\"]
        if len(a) > 2 or len(left) < reach or reach > 4096:
            break
        reach *= 8
    right = text[e : e + 16].partition("\n")[0]
    b = [t for t in TOKEN.findall(right) if t not in "\"'\\"][:1]
    a = a[-2:]
    low = lambda t: "0" if t[0].isdigit() else t.lower()
    kind = lambda t: "Xx" if t[0].isupper() else low(t)
    after = ["@"] if MAIL_NEXT.match(text, e) else map(kind, b)
    return " ".join(map(low, a)) + " _ " + " ".join(map(low, b)), " ".join(map(kind, a)) + " _ " + " ".join(after)


def lower(t: str) -> str:
    low = t.lower()
    return low if len(low) == len(t) else "".join(x if len(x := c.lower()) == 1 else c for c in t)


def near(t: str) -> dict[str, list[int]]:
    """Places where the words of NEAR begin, by type; those of streets only where case or a number beside them fits."""
    if not hasattr(near, "words"):
        import ahocorasick

        near.words = ahocorasick.Automaton()
        of: dict[str, list[str]] = {}
        for kind, words in NEAR.items():
            for w in words:
                of.setdefault(w, []).append(kind)
        for w, kinds in of.items():
            near.words.add_word(w, (len(w), kinds))
        near.words.make_automaton()
    at: dict[str, list[int]] = {kind: [] for kind in ("email", "id_number", "street_address")}
    for end, (n, kinds) in near.words.iter(lower(t)):
        p = end - n + 1
        for kind in kinds:
            if kind in at:
                at[kind].append(p)
            elif (
                t[p + 1].isupper() and not t[end + 1 : end + 2].isalpha()
                if kind == "en"
                else any(map(str.isdigit, t[max(0, p - 10) : p]))
                if kind == "fr"
                else any(map(str.isdigit, t[end + 1 : end + 3]))
                if kind == "de"
                else t[p].isupper() and not (p and t[p - 1].isalpha())
            ):
                at["street_address"].append(p)
    return at


def _before(t: str, end: int) -> re.Match | None:
    """The local part that ends at ``end``, however long it is; its places count from the first character looked at."""
    reach = 80
    while True:
        base = max(0, end - reach)
        m = LOCAL.search(t[base:end])
        if not m or m.start() or not base:
            return m and (base + m.start())
        reach *= 8


def emails(t: str, at: list[int]) -> Iterator[tuple]:
    done = -1
    for p in at:
        m = next((m for q in (p - 1, p, p + 1) if q >= max(0, done) and (m := AT.match(t, q))), None)
        if not m:
            continue
        done = m.end()
        sign = m.group()
        s, right = _before(t, m.start()), DOMAIN.match(t, m.end())
        if s is None or not right:
            continue
        e, domain = right.end(), right.group()
        if sign == "@":
            s = m.start()
            while s and (t[s - 1].isalnum() or t[s - 1] in "._+-"):
                s -= 1
            if re.search(r"\s", domain):
                right = PLAIN_DOMAIN.match(t, m.end())
                if not right:
                    continue
                e = right.end()
            if s == m.start() or (t[e : e + 1] == ":" and t[e + 1 : e + 2].isalpha()):
                continue
        elif sign.strip().lower() == "at" and not re.search(r"\bdot\b|[\[({]", domain, re.I):
            continue
        yield "email", s, e, None, None, True


def phones(t: str) -> Iterator[tuple]:
    done = 0
    for x in PHONE_START.finditer(t):
        m = PHONE.match(t, x.start()) if x.start() >= done else None
        if not m:
            continue
        done = m.end()
        n = sum(c.isdigit() for c in m.group())
        if 8 <= n <= 15:
            yield "phone", m.start(), m.end(), None, None, m.group("s") is not None


def identities(t: str, at: list[int]) -> Iterator[tuple]:
    ends = set()
    for p in at:
        m = next((m for q in range(max(0, p - 6), p + 1) if (m := ID_LABEL.match(t, q))), None)
        v = m and ID_VALUE.match(t, m.end())
        if not v or v.start("v") in ends:
            continue
        value = ID_TAIL.sub("", v.group("v"))
        if 6 <= sum(c.isdigit() for c in value) <= 15:
            ends.add(v.start("v"))
            yield "id_number", v.start("v"), v.start("v") + len(value), None, None, True
    for x in ID_START.finditer(t):
        m = ID_SHAPE.match(t, x.start())
        if m and m.start() not in ends and sum(map(str.isdigit, m.group())) >= 5:
            yield "id_number", m.start(), m.end(), None, None, False


def _streets_at(t: str, p: int, done: int) -> list[tuple[int, int]]:
    """Streets around a word at ``p``, within as many words as a street can have; in text without blanks the part looked at grows while a street reaches its ends."""
    first, last = p, p
    for _ in range(8):
        first = max(t.rfind(" ", 0, max(first, 0)), -1)
        last = q if (q := t.find(" ", last + 1)) >= 0 else len(t)
    first = max(first + 1, done)
    before, after = (p - first, last - p) if last - first < 2000 else (60, 100)
    while True:
        a, b = max(first, p - before), min(last, p + after)
        if not any(map(str.isdigit, t[a:b])):
            return []
        found = [(m.start(), m.start() + len(m.group().rstrip()), m.end()) for m in STREET.finditer(t, a, b) if m.start() <= p + 2 or m.end() >= p]
        cut_left, cut_right = any(s == a > first for s, _, _ in found), any(e == b < last for _, _, e in found)
        if not cut_left and not cut_right:
            return [(s, e) for s, e, _ in found]
        before, after = before * (8 if cut_left else 1), after * (8 if cut_right else 1)


def streets(t: str, at: list[int]) -> Iterator[tuple]:
    done, seen = 0, set()
    for p in at:
        for s, e in _streets_at(t, p, done):
            yield "street_address", s, e, None, None, True
            seen.add(s)
            done = max(done, e)
    for m in WIDE_STREET.finditer(t):
        if m.start() not in seen:
            yield "street_address", m.start(), m.start("n") + len(m.group("n").rstrip()), None, None, False


def names(t: str) -> Iterator[tuple]:
    for m in NAME.finditer(t):
        first = m.start()
        g, f = (m.group() + m.group("g"), m.group("f")) if m.group("f") else (m.group("g2"), m.group() + m.group("f2"))
        if g in TITLES or f in TITLES:
            continue
        end = max(m.end("f"), m.end("g2"))
        if m.group("g2") and (x := re.compile(rf" [{UP}]\.").match(t, end)):
            end = x.end()
        yield "person_name", first, end, g.lower(), f.lower(), False
    for m in NAME_JA.finditer(t):
        yield "person_name", m.start(), m.end(), m.group("g"), m.group("f"), False


def candidates(text: str) -> Iterator[tuple]:
    t = plain(text)
    at = near(t)
    for found in (emails(t, at["email"]), phones(t), identities(t, at["id_number"]), streets(t, at["street_address"]), names(t)):
        for kind, s, e, a, b, seed in found:
            yield kind, s, e, text[s:e], a, b, *pattern_of(t, s, e), seed


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("pii_type", pa.string()), ("s", pa.int32()), ("e", pa.int32()), *((c, pa.string()) for c in ("pii_text", "part_a", "part_b", "pattern", "frame")), ("seed", pa.bool_())])
    rows: list = []
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rows.extend((doc, *c) for c in candidates(text))
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _learn_names(graph: DataFrame, given: DataFrame, family: DataFrame, rounds: int, support: int, confidence: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(given, family, patterns) after ``rounds`` rounds over the graph (pattern, part_a, part_b, n); each round writes one table of parts."""
    initial = F.col("part_a").rlike(r"^.\.$")

    def marked() -> DataFrame:
        known = graph.join(given.withColumn("ka", F.lit(True)), "part_a", "left").join(family.withColumn("kb", F.lit(True)), "part_b", "left")
        return known.withColumn("ka", F.coalesce("ka", F.lit(False))).withColumn("kb", F.coalesce("kb", F.lit(False)))

    def scored(known: DataFrame) -> DataFrame:
        both = F.col("kb") & (F.col("ka") | initial)
        one = F.col("kb") | F.col("ka")
        hit = F.sum(F.when(both, F.col("n")).when(one, F.col("n") * 0.5).otherwise(0))
        return known.groupBy("pattern").agg(hit.alias("hit"), F.sum("n").alias("n"), F.count_if(one).alias("distinct_hits")).select("pattern", "distinct_hits", (F.col("hit") / F.col("n")).alias("score"))

    for last in [False] * (rounds - 1) + [True]:
        known = marked()
        patterns = scored(known)
        if last:
            patterns = stage(patterns, "patterns")
        good = patterns.where((F.col("distinct_hits") >= support) & (F.col("score") >= confidence)).select("pattern").withColumn("good", F.lit(True))
        seen = known.join(good, "pattern", "left").withColumn("good", F.coalesce("good", F.lit(False)))

        def parts(col: str, other: str) -> DataFrame:
            # a new part stands mostly in good patterns, and beside a known part at least once
            x = seen.groupBy(col).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("in_good"), F.max(other).alias("beside"))  # noqa: B023
            return x.where((F.col("in_good") >= 0.6 * F.col("n")) & F.col("beside") & (F.length(col) > 2)).select(col)

        of = lambda kind, x, y: x.union(y).distinct().toDF("part").withColumn("kind", F.lit(kind))
        both_kinds = stage(of("given", given, parts("part_a", "kb")).union(of("family", family, parts("part_b", "ka"))), "parts")
        given, family = (both_kinds.where(F.col("kind") == k).select(F.col("part").alias(c)) for k, c in (("given", "part_a"), ("family", "part_b")))
    return given, family, patterns


def _learn(graph: DataFrame, rounds: int, support: int, confidence: float) -> DataFrame:
    """Known instances (pii_type, inst) after ``rounds`` rounds over the graph (pii_type, inst, pattern, frame, n, seed)."""
    known = graph.where("seed").select("pii_type", "inst").distinct()
    for _ in range(rounds):
        seen = graph.join(known.withColumn("known", F.lit(True)), ["pii_type", "inst"], "left").withColumn("known", F.coalesce("known", F.lit(False)))

        def good(col: str) -> DataFrame:
            hit = F.when(F.col("known"), F.col("n")).otherwise(0)
            scored = seen.groupBy("pii_type", col).agg(F.sum(hit).alias("hit"), F.sum("n").alias("n"), F.count_if("known").alias("distinct_hits"))  # noqa: B023
            return scored.where((F.col("distinct_hits") >= support) & (F.col("hit") >= confidence * F.col("n"))).select("pii_type", col, F.lit(True).alias(f"good_{col}"))

        # a label is what tells numbers of persons from others, so their frames don't count
        marked = seen.join(good("pattern"), ["pii_type", "pattern"], "left").join(good("frame"), ["pii_type", "frame"], "left")
        mark = F.coalesce("good_pattern", F.col("good_frame") & (F.col("pii_type") != "id_number"), F.lit(False))
        fresh = marked.groupBy("pii_type", "inst").agg(F.sum(F.when(mark, F.col("n")).otherwise(0)).alias("in_good"), F.sum("n").alias("n")).where("2 * in_good >= n AND in_good > 0").select("pii_type", "inst")
        known = stage(known.union(fresh).distinct(), "known")
    return known


def find_pii(df: DataFrame, name_parts: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, support: int = 3, confidence: float = 0.5) -> DataFrame:
    """Accepted spans (doc_id, pii_type, s, e, pii_text); spans of a text don't overlap.

    Null and empty texts have none. ``name_parts`` has name_part and part_kind (given, family); it may be incomplete or empty.
    """
    texts = df.where(F.col(text_col) != "").select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    found = stage(texts.mapInArrow(_candidates, CANDIDATE), "candidates")
    part = lambda kind, col: name_parts.where(F.col("part_kind") == kind).select(F.lower("name_part").alias(col)).where(F.col(col).isNotNull()).distinct()

    people = found.where("pii_type = 'person_name'")
    graph = stage(people.groupBy("pattern", "part_a", "part_b").agg(F.count(F.lit(1)).alias("n")), "graph")
    given, family, patterns = _learn_names(graph, part("given", "part_a"), part("family", "part_b"), rounds, support, confidence)
    # distinct names are judged once, however many texts hold them
    initial = F.col("part_a").rlike(r"^.\.$")
    scored = graph.join(given.withColumn("ka", F.lit(True)), "part_a", "left").join(family.withColumn("kb", F.lit(True)), "part_b", "left").join(patterns, "pattern", "left")
    good = (F.col("distinct_hits") >= support) & (F.col("score") >= confidence)
    both = F.coalesce("kb", F.lit(False)) & (F.coalesce("ka", F.lit(False)) | initial)
    one = F.coalesce("kb", F.lit(False)) | F.coalesce("ka", F.lit(False))
    sure = (F.col("distinct_hits") >= SURE_HITS) & (F.col("score") >= SURE_SCORE)
    rank = F.when(both & (F.col("score") >= 0.2), 3).when(one & good, 2).when(sure, 1)
    accepted = scored.select("pattern", "part_a", "part_b", rank.alias("rank")).where("rank IS NOT NULL")
    names = people.join(accepted, ["pattern", "part_a", "part_b"]).select("doc_id", "pii_type", "s", "e", "pii_text", "rank")

    others = found.where("pii_type <> 'person_name'").withColumn("inst", F.lower("pii_text"))
    known = _learn(stage(others.groupBy("pii_type", "inst", "pattern", "frame").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")), "graph"), rounds, support, confidence)
    rest = others.join(known, ["pii_type", "inst"], "left_semi").select("doc_id", "pii_type", "s", "e", "pii_text", F.when(F.col("seed"), 4).otherwise(2).alias("rank"))
    spans = names.union(rest)
    return spans.repartition("doc_id").sortWithinPartitions("doc_id", F.desc("rank"), F.col("s") - F.col("e"), "s").mapInArrow(_apart, "doc_id bigint, pii_type string, s int, e int, pii_text string")


#: A pattern in which names of unknown parts are accepted: distinct known names in it, and their share.
SURE_HITS, SURE_SCORE = 20, 0.9


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans, sorted by document and rank, without those that overlap one before them."""
    doc, taken = None, []
    for b in batches:
        keep = []
        for i, (d, s, e) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "s", "e")))):
            if d != doc:
                doc, taken = d, []
            at = bisect.bisect(taken, (s, e))
            if (at and taken[at - 1][1] > s) or (at < len(taken) and taken[at][0] < e):
                continue
            taken.insert(at, (s, e))
            keep.append(i)
        if keep:
            yield b.take(pa.array(keep)).drop_columns(["rank"])


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            if spans:
                parts, at = [], 0
                for s, e, kind in united(spans):
                    parts += [text[at:s], PLACEHOLDER[kind]]
                    at = e
                text = "".join([*parts, text[at:]])
            out.append(text)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def united(spans: list[dict]) -> list[tuple[int, int, str]]:
    """(start, end, type) of what the spans cover; overlapping ones become one span with the type of the longest."""
    out: list[list] = []
    for x in sorted(spans, key=lambda x: (x["s"], -x["e"])):
        if out and x["s"] < out[-1][1]:
            last = out[-1]
            last[1] = max(last[1], x["e"])
            if x["e"] - x["s"] > last[3]:
                last[2:] = [x["pii_type"], x["e"] - x["s"]]
        else:
            out.append([x["s"], x["e"], x["pii_type"], x["e"] - x["s"]])
    return [(s, e, kind) for s, e, kind, _ in out]


def redact(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of every row with a typed placeholder for each span; overlapping spans are covered as one, with the type of the longest."""
    of_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("pii_type", "s", "e")).alias("spans"))  # bounded by its text
    full = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).join(of_doc, "doc_id", "left")
    return full.mapInArrow(_cover, "doc_id bigint, text string").withColumnRenamed("doc_id", id_col)
