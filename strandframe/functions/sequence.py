"""Column functions over sequences: case, composition, complement, hashes, quality."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and their complements.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DNA, DNA_COMPLEMENT = "ACGTRYSWKMBDHVNacgtryswkmbdhvn", "TGCAYRSWMKVHDBNtgcayrswmkvhdbn"
RNA, RNA_COMPLEMENT = "ACGURYSWKMBDHVNacguryswkmbdhvn", "UGCAYRSWMKVHDBNugcayrswmkvhdbn"
#: Letters of each alphabet, gaps among them.
ALPHABET = {"dna": "ACGTRYSWKMBDHVN", "rna": "ACGURYSWKMBDHVN", "protein": "ABCDEFGHIJKLMNPQRSTUVWXYZ*"}
GAPS = "-.? "
#: Lowest and highest code, and code of score 0, of each quality format.
QUALITY = {"sanger": (33, 126, 33), "illumina": (64, 126, 64), "solexa": (59, 126, 64)}


def ascii_upper(x: Column) -> Column:
    """Upper case of ASCII letters alone; other letters stay (case maps of whole Unicode change lengths)."""
    return F.when(_ascii(x), F.upper(x)).otherwise(F.translate(x, LOWER, UPPER))


def ascii_lower(x: Column) -> Column:
    return F.when(_ascii(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def _ascii(x: Column) -> Column:
    """Whether a text has ASCII characters alone; then its case is mapped byte by byte, which is much faster than ``translate``."""
    return F.octet_length(x) == F.length(x)


def seqlen(x: Column) -> Column:
    return F.length(x).cast("bigint")


def ungapped_len(x: Column) -> Column:
    return F.length(F.replace(x, F.lit("-"), F.lit(""))).cast("bigint")


def char_count(x: Column, chars: str) -> Column:
    """How many characters of ``x`` are among ``chars``; a few are searched for one by one, as ``translate`` takes every character apart."""
    letters = list(dict.fromkeys(chars))
    if len(letters) > 8:
        return (F.length(x) - F.length(F.translate(x, chars, ""))).cast("bigint")
    left = x
    for c in letters:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.length(x) - F.length(left)).cast("bigint") if letters else F.lit(0).cast("bigint")


def gc(x: Column) -> Column:
    """Share of G and C among A, C, G, T and U, upper case only; NaN without any."""
    n, total = char_count(x, "GC"), char_count(x, "ACGTU")
    return F.when(total == 0, F.lit(float("nan"))).otherwise(n / F.when(total == 0, 1).otherwise(total))


def is_type(text: str, name: str = "dna") -> bool:
    """Whether a text on the driver has letters of an alphabet (U counts as T) and gaps alone."""
    return set(text.upper().replace("U", "T")) <= set(ALPHABET[name]) | set(GAPS)


def is_alphabet(x: Column, name: str) -> Column:
    letters = ALPHABET[name]
    return F.length(F.translate(x, letters + letters.lower() + GAPS, "")) == 0


def complement(x: Column, seqtype: str = "auto") -> Column:
    """``auto``: RNA where there is a U and no T, else DNA. Letters beyond the alphabet are an error with a given or guessed type."""
    dna, rna = F.translate(x, DNA, DNA_COMPLEMENT), F.translate(x, RNA, RNA_COMPLEMENT)
    if seqtype == "dna":
        return dna
    if seqtype == "rna":
        return rna
    return F.when(x.rlike("[Uu]") & ~x.rlike("[Tt]"), rna).otherwise(dna)


def reverse_complement(x: Column, seqtype: str = "auto", strict: bool = False) -> Column:
    out = F.reverse(complement(x, seqtype))
    if strict:
        ok = is_alphabet(x, "dna") | is_alphabet(x, "rna") if seqtype == "auto" else is_alphabet(x, seqtype)
        return F.when(ok, out).otherwise(F.raise_error(F.concat(F.lit("no complement of "), x)).cast("string"))
    return out


def seq_hash(x: Column) -> Column:
    """A 64-bit hash for keys inside the engine (another function than ``xxh3``)."""
    return F.xxhash64(x)


def xxh3(x: Column) -> Column:
    """XXH3 of the bytes as a signed integer, on Arrow batches; null for null."""

    @F.pandas_udf("bigint")  # type: ignore[call-overload]
    def run(x: pd.Series) -> pd.Series:
        import xxhash

        return x.map(lambda v: None if v is None else (h - (1 << 64) if (h := xxhash.xxh3_64_intdigest(v.encode())) >> 63 else h)).astype("Int64")

    return run(x)


def unsigned_least(a: Column, b: Column) -> Column:
    flip = lambda c: c.bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(flip(a) <= flip(b), a).otherwise(b)


def _codes(x: Column) -> Column:
    return F.transform(F.filter(F.split(x, ""), lambda c: c != ""), F.ascii)


def check_quality(qual: Column, fmt: str) -> Column:
    lo, hi, _ = QUALITY[fmt]
    bad = F.exists(_codes(qual), lambda c: (c < lo) | (c > hi))
    return F.when(bad, F.raise_error(F.concat(F.lit(f"invalid {fmt} quality: "), qual)).cast("string")).otherwise(qual)


def _phred_of(score: int, fmt: str) -> int:
    import math

    return math.floor(10 * math.log10(10 ** (score / 10) + 1) + 0.5) if fmt == "solexa" else score


def _solexa_of(phred: int) -> int:
    import math

    return -5 if phred <= 0 else max(-5, math.floor(10 * math.log10(max(10 ** (phred / 10) - 1, 1e-9)) + 0.5))


def convert_quality(qual: Column, source: str, target: str) -> Column:
    """Qualities in another format; scores too high for the target take its highest code. One translate of at most 94 letters."""
    if source == target:
        return check_quality(qual, source)
    lo, hi, zero = QUALITY[source]
    tlo, thi, tzero = QUALITY[target]
    to = []
    for code in range(lo, hi + 1):
        phred = _phred_of(code - zero, source)
        score = _solexa_of(phred) if target == "solexa" else phred
        to.append(chr(min(thi, max(tlo, score + tzero))))
    return F.translate(check_quality(qual, source), "".join(map(chr, range(lo, hi + 1))), "".join(to))


def phred_list(qual: Column, fmt: str = "sanger") -> Column:
    """Scores as numbers parted by single blanks."""
    return F.array_join(F.transform(_codes(convert_quality(qual, fmt, "sanger")), lambda c: (c - 33).cast("string")), " ")


def quality_of_phred(scores: Column) -> Column:
    """Sanger qualities of numbers parted by single blanks; anything else between them is an error."""
    ok = scores.rlike(r"^([0-9]+( [0-9]+)*)?$")
    chars = F.transform(F.filter(F.split(scores, " "), lambda x: x != ""), lambda x: F.char(F.least(x.try_cast("int"), F.lit(93)) + 33))
    return F.when(ok, F.array_join(chars, "")).otherwise(F.raise_error(F.concat(F.lit("invalid quality scores: "), scores)).cast("string"))


def exp_err(qual: Column, fmt: str = "sanger") -> Column:
    """Expected number of errors: the sum of error probabilities; Solexa from its own scores. 0 for '', null for null."""
    zero = QUALITY[fmt][2]
    p = (lambda c: F.lit(1.0) / (F.pow(F.lit(10.0), (c - zero) / F.lit(10.0)) + 1)) if fmt == "solexa" else (lambda c: F.pow(F.lit(10.0), -(c - zero) / F.lit(10.0)))
    return F.aggregate(_codes(qual), F.lit(0.0), lambda a, c: a + p(c))
