"""Numbers as text: at most six significant digits, NaN and Infinity by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6
#: Decimal exponents from which on, and below which, a number is written with an exponent.
LARGE, SMALL = 9, -5


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once; a plain column would be copied into each place it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _place_point(digits: Column, e: Column, sign: Column) -> Column:
    n = F.length(digits)
    fraction = lambda head, tail: F.when(tail == "", head).otherwise(F.concat(head, F.lit("."), tail))
    plain = (
        F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits))
        .when(e >= n, F.rpad(digits, e + 1, F.lit("0")))
        .otherwise(fraction(F.substr(digits, F.lit(1), e + 1), F.substr(digits, e + 2)))
    )
    power = F.concat(fraction(F.substr(digits, F.lit(1), F.lit(1)), F.substr(digits, F.lit(2))), F.lit("e"), e.cast("string"))
    return F.concat(sign, F.when((e >= LARGE) | (e < SMALL), power).otherwise(plain))


def format_double(x: Column) -> Column:
    """A number whose shortest form has six digits or fewer is written so; a longer one is rounded to six, zeros kept. Null stays null."""

    def finite(v: Column) -> Column:
        def parts(r: Column) -> Column:
            six = F.concat(F.substr(r, F.lit(1), F.lit(1)), F.substr(r, F.lit(3), F.lit(DIGITS - 1)))
            shortest = F.length(F.regexp_replace(F.regexp_replace(F.abs(v).cast("string"), r"E.*|\.", ""), "^0+|0+$", ""))
            digits = F.when(shortest <= DIGITS, F.regexp_replace(six, "(?<=.)0+$", "")).otherwise(six)
            return F.struct(digits.alias("d"), F.regexp_extract(r, "e(.*)$", 1).cast("int").alias("e"))

        split = let(F.format_string(f"%.{DIGITS - 1}e", F.abs(v)), parts)
        return let(split, lambda p: _place_point(p["d"], p["e"], F.when(v < 0, "-").otherwise("")))

    def any_(v: Column) -> Column:
        return F.when(F.isnan(v), "NaN").when(v == float("inf"), "Infinity").when(v == -float("inf"), "-Infinity").when(v == 0, "0").otherwise(finite(v))

    return F.when(x.isNotNull(), let(x.cast("double"), any_))


def bin_start(x: Column, width: Column) -> Column:
    """The start of the bin of x; NaN and infinities stay what they are."""
    return let(x / width, lambda q: F.when(F.isnan(q) | (F.abs(q) >= float(1 << 53)), q * width).otherwise(F.floor(q) * width))


def format_bin(start: Column, width: Column) -> Column:
    return let(start, lambda c: F.concat(F.lit("("), format_double(c), F.lit(", "), format_double(c + width), F.lit("]")))


def parse_number(text: Column) -> Column:
    """Text as a number; an error if it isn't one. Blanks around it aren't allowed."""
    ok = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(inf|infinity|nan)$|^[+-]?(Inf|Infinity|NaN)$")
    return F.when(text.isNull(), F.lit(None).cast("double")).when(ok, text.try_cast("double")).otherwise(F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double"))
