"""Ranges ``start:end``, lists of them, and their bounds as columns over a text's length."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Range:
    """1-based and inclusive; negative counts from the end; None is open. Bounds may be numbers or columns."""

    start: int | Column | None
    end: int | Column | None

    def bounds(self, length: Column, exclusive: bool = False, zero_based: bool = False) -> tuple[Column, Column]:
        """0-based start and end (not included), within the text; an empty range has equal ones."""
        s = None if self.start is None else _col(self.start)
        e = None if self.end is None else _col(self.end)
        if exclusive:
            s, e = None if s is None else s + 1, None if e is None else F.when(e == 0, e).otherwise(e - 1)
        if not zero_based:
            s = None if s is None else F.when(s >= 1, s - 1).otherwise(s)
            e = None if e is None else F.when(e == -1, length).when(e <= -2, e + 1).otherwise(e)
        s = F.lit(0) if s is None else F.coalesce(s, F.lit(0))
        e = length if e is None else F.coalesce(e, length)
        place = lambda x: F.least(length, F.when(x < 0, F.greatest(F.lit(0), length + x)).otherwise(x))
        s, e = place(s), place(e)
        return s.cast("int"), F.greatest(s, e).cast("int")


def _col(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def parse_range(text: str) -> Range:
    start, sep, end = text.strip().partition(":")
    if not sep:
        raise ValueError(f"a range is start:end, not {text!r}")
    one = lambda x: None if x.strip() in ("", "undefined") else int(x)
    return Range(one(start), one(end))


def parse_ranges(text: str) -> list[Range]:
    return [parse_range(x) for x in text.split(",")]


def cut(text: Column, ranges: list[Range], exclusive: bool = False, zero_based: bool = False) -> Column:
    """The ranges of a text, one after another."""
    length = F.length(text)
    parts = [F.substr(text, s + 1, e - s) for s, e in (r.bounds(length, exclusive, zero_based) for r in ranges)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def change(text: Column, ranges: list[Range], how, exclusive: bool = False, zero_based: bool = False) -> Column:
    """``how`` applied to each range, the rest kept; lengths must stay."""
    for r in ranges:
        s, e = r.bounds(F.length(text), exclusive, zero_based)
        text = F.concat(F.substr(text, F.lit(1), s), how(F.substr(text, s + 1, e - s)), F.substr(text, e + 1))
    return text
