"""Typed columns of the expression language, and how types turn into one another."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import format_bin, format_double

TEXT, INT, NUM, BOOL, BIN = "text", "int", "num", "bool", "bin"
UNDEFINED = "undefined"


class ExpressionError(ValueError):
    """An expression that can't be read, or that this engine doesn't take."""


@dataclass(frozen=True)
class Value:
    """A column with its type; null is the undefined value. ``width`` is that of a bin, ``const`` a literal's value."""

    col: Column
    kind: str
    width: Column | None = None
    const: object = None

    def text(self) -> Column:
        """As text, null staying null."""
        if self.kind == TEXT:
            return self.col
        if self.kind == BOOL:
            return F.when(self.col, "true").when(~self.col, "false")
        if self.kind == INT:
            return self.col.cast("string")
        if self.kind == BIN:
            return format_bin(self.col, self.width)
        return format_double(self.col)

    def printed(self) -> Column:
        return F.coalesce(self.text(), F.lit(UNDEFINED))

    def number(self) -> Column:
        """As JavaScript turns it into a number: undefined and other text are NaN, '' is 0."""
        if self.kind in (NUM, INT, BIN):
            return F.coalesce(self.col.cast("double"), F.lit(float("nan")))
        if self.kind == BOOL:
            return F.coalesce(self.col.cast("double"), F.lit(float("nan")))
        return F.coalesce(F.when(F.trim(self.col) == "", 0.0).otherwise(self.col.try_cast("double")), F.lit(float("nan")))

    def truth(self) -> Column:
        if self.kind == BOOL:
            return F.coalesce(self.col, F.lit(False))
        if self.kind == TEXT:
            return F.coalesce(self.col != "", F.lit(False))
        return F.coalesce((self.col != 0) & ~F.isnan(self.col.cast("double")), F.lit(False))

    def sort_columns(self) -> list[Column]:
        """Columns that order values; text before numbers where both occur in one key, undefined last."""
        if self.kind == BIN:
            return [self.col, self.width]
        return [self.col]


def lit(v: object) -> Value:
    if isinstance(v, bool):
        return Value(F.lit(v), BOOL, const=v)
    if isinstance(v, int):
        return Value(F.lit(v).cast("bigint"), INT, const=v)
    if isinstance(v, float):
        return Value(F.lit(v), NUM, const=v)
    if v is None:
        return Value(F.lit(None).cast("string"), TEXT)
    return Value(F.lit(v), TEXT, const=v)


def common(a: Value, b: Value) -> tuple[Column, Column, str]:
    """Two values as columns of one type, for a conditional."""
    if a.kind == b.kind:
        return a.col, b.col, a.kind
    if {a.kind, b.kind} <= {INT, NUM}:
        return a.col.cast("double"), b.col.cast("double"), NUM
    return a.text(), b.text(), TEXT
