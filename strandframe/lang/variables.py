"""The registry of variables and functions: name to a builder of a typed column."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numbers, sequence
from ..functions.attrs import AttrFormat
from .values import BIN, BOOL, INT, NUM, TEXT, ExpressionError, Value


@dataclass
class Context:
    """What variables can refer to while an expression is compiled.

    ``meta``: per metadata source the names of its columns, in order; the values stand in the record
    as ``_meta<i>_<n>`` (see operators.meta). ``extra`` has variables that a single operator adds. ``deleted`` collects the attributes
    that attr_del and opt_attr_del name; operators that give records remove them (``without_deleted``).
    """

    attr_format: AttrFormat = dataclasses.field(default_factory=AttrFormat)
    quality: str = "sanger"
    seqtype: str = "auto"
    default_ext: str = "fasta"
    meta: list[list[str]] = dataclasses.field(default_factory=list)
    deleted: list[str] = dataclasses.field(default_factory=list)
    extra: dict[str, Callable] = dataclasses.field(default_factory=dict)
    registry: dict[str, tuple] = dataclasses.field(default_factory=lambda: REGISTRY)

    def known(self, name: str) -> bool:
        return name in self.extra or name in self.registry

    def call(self, name: str, args: list[Value]) -> Value:
        if name in self.extra:
            return self.extra[name](self, *args)
        if name not in self.registry:
            raise ExpressionError(f"unknown variable or function: {name}")
        build, least, most = self.registry[name]
        if not least <= len(args) <= most:
            raise ExpressionError(f"{name} takes {least} to {most} arguments, not {len(args)}")
        return build(self, *args)


REGISTRY: dict[str, tuple] = {}


def variable(*names: str, args: tuple[int, int] = (0, 0)):
    def register(build: Callable) -> Callable:
        for n in names:
            REGISTRY[n] = (build, *args)
        return build

    return register


def constant(v: Value | None, default: object, what: type) -> object:
    if v is None:
        return default
    if v.const is None:
        raise ExpressionError("an argument must be a literal here")
    if what is bool:
        return v.const in (True, "true", "1", 1)
    return what(v.const)


def field(name: str) -> Column:
    """Columns are made when an expression is compiled, as a session must exist for them."""
    return F.col(name)


REGISTRY["id"] = (lambda ctx: Value(field("id"), TEXT), 0, 0)
REGISTRY["seq"] = (lambda ctx: Value(field("seq"), TEXT), 0, 0)
REGISTRY["desc"] = (lambda ctx: Value(F.coalesce(field("desc"), F.lit("")), TEXT), 0, 0)
REGISTRY["upper_seq"] = (lambda ctx: Value(sequence.ascii_upper(field("seq")), TEXT), 0, 0)
REGISTRY["lower_seq"] = (lambda ctx: Value(sequence.ascii_lower(field("seq")), TEXT), 0, 0)
REGISTRY["seqlen"] = (lambda ctx: Value(sequence.seqlen(field("seq")), INT), 0, 0)
REGISTRY["ungapped_seqlen"] = (lambda ctx: Value(sequence.ungapped_len(field("seq")), INT), 0, 0)
REGISTRY["gc"] = (lambda ctx: Value(sequence.gc(field("seq")), NUM), 0, 0)
REGISTRY["gc_percent"] = (lambda ctx: Value(sequence.gc(field("seq")) * 100, NUM), 0, 0)
REGISTRY["exp_err"] = (lambda ctx: Value(sequence.exp_err(F.col("qual"), ctx.quality), NUM), 0, 0)
REGISTRY["default_ext"] = (lambda ctx: Value(F.lit(ctx.default_ext), TEXT, const=ctx.default_ext), 0, 0)


@variable("charcount", args=(1, 1))
def _charcount(ctx: Context, chars: Value) -> Value:
    return Value(sequence.char_count(field("seq"), constant(chars, "", str)), INT)


def _cased(ctx: Context, ignorecase: Value | None) -> Column:
    return sequence.ascii_upper(field("seq")) if constant(ignorecase, False, bool) else field("seq")


@variable("seqhash", args=(0, 1))
def _seqhash(ctx: Context, ignorecase: Value | None = None) -> Value:
    return Value(sequence.seq_hash(_cased(ctx, ignorecase)), INT)


@variable("seqhash_rev", args=(0, 1))
def _seqhash_rev(ctx: Context, ignorecase: Value | None = None) -> Value:
    return Value(sequence.seq_hash(sequence.reverse_complement(_cased(ctx, ignorecase), ctx.seqtype)), INT)


@variable("seqhash_min", args=(0, 1))
def _seqhash_min(ctx: Context, ignorecase: Value | None = None) -> Value:
    s = _cased(ctx, ignorecase)
    return Value(sequence.unsigned_least(sequence.seq_hash(s), sequence.seq_hash(sequence.reverse_complement(s, ctx.seqtype))), INT)


@variable("seq_num", args=(0, 1))
def _seq_num(ctx: Context, reset: Value | None = None) -> Value:
    """Needs the numbers of operators.position.number_records."""
    return Value(F.col("_file_num" if constant(reset, False, bool) else "_num"), INT)


@variable("seq_idx", args=(0, 1))
def _seq_idx(ctx: Context, reset: Value | None = None) -> Value:
    return Value(F.col("_file_num" if constant(reset, False, bool) else "_num") - 1, INT)


def _path() -> Column:
    return F.coalesce(F.col("_path"), F.lit("-"))


def _file(plain: bool = False) -> Column:
    name = F.element_at(F.split(_path(), "/"), -1)
    return F.regexp_replace(name, r"(?i)\.(gz|bz2|lz4|zst|zstd)$", "") if plain else name


REGISTRY["path"] = (lambda ctx: Value(_path(), TEXT), 0, 0)
REGISTRY["filename"] = (lambda ctx: Value(_file(), TEXT), 0, 0)
REGISTRY["filestem"] = (lambda ctx: Value(F.regexp_replace(_file(True), r"\.[^.]*$", ""), TEXT), 0, 0)
REGISTRY["extension"] = (lambda ctx: Value(F.regexp_extract(_file(True), r"\.([^.]*)$", 1), TEXT), 0, 0)
REGISTRY["dirname"] = (lambda ctx: Value(F.when(F.instr(_path(), "/") > 0, F.regexp_replace(_path(), "/[^/]*$", "")).otherwise(""), TEXT), 0, 0)


@variable("attr", args=(1, 1))
def _attr(ctx: Context, name: Value) -> Value:
    n = constant(name, "", str)
    v = ctx.attr_format.get(n, field("id"), field("desc"))
    return Value(F.when(v.isNotNull(), v).otherwise(F.raise_error(F.concat(F.lit(f"no attribute {n} in record "), field("id"))).cast("string")), TEXT)


@variable("opt_attr", args=(1, 1))
def _opt_attr(ctx: Context, name: Value) -> Value:
    return Value(ctx.attr_format.get(constant(name, "", str), field("id"), field("desc")), TEXT)


def _delete(ctx: Context, name: Value) -> Value:
    n = constant(name, "", str)
    if n not in ctx.deleted:
        ctx.deleted.append(n)
    return name


@variable("attr_del", args=(1, 1))
def _attr_del(ctx: Context, name: Value) -> Value:
    return _attr(ctx, _delete(ctx, name))


@variable("opt_attr_del", args=(1, 1))
def _opt_attr_del(ctx: Context, name: Value) -> Value:
    return _opt_attr(ctx, _delete(ctx, name))


def without_deleted(ctx: Context, id: Column, desc: Column) -> tuple[Column, Column]:
    """(id, desc) without the attributes that expressions of this context have taken out."""
    return ctx.attr_format.delete(ctx.deleted, id, desc) if ctx.deleted else (id, desc)


@variable("has_attr", args=(1, 1))
def _has_attr(ctx: Context, name: Value) -> Value:
    return Value(ctx.attr_format.get(constant(name, "", str), field("id"), field("desc")).isNotNull(), BOOL)


def meta_column(ctx: Context, column: Value, file: Value | None) -> Column:
    i = constant(file, 1, int) - 1
    if not 0 <= i < len(ctx.meta):
        raise ExpressionError(f"there is no metadata source {i + 1}")
    names, c = ctx.meta[i], column.const
    if isinstance(c, str) and c.isdigit():
        c = int(c)
    if isinstance(c, int):
        if not 1 <= c <= len(names):
            raise ExpressionError(f"metadata source {i + 1} has no column {c}")
        return F.col(f"_meta{i}_{c - 1}")
    if c not in names:
        raise ExpressionError(f"metadata source {i + 1} has no column {c!r}")
    return F.col(f"_meta{i}_{names.index(c)}")


@variable("meta", args=(1, 2))
def _meta(ctx: Context, column: Value, file: Value | None = None) -> Value:
    i = constant(file, 1, int) - 1
    v = meta_column(ctx, column, file)
    return Value(F.when(F.col(f"_meta{i}_has"), v).otherwise(F.raise_error(F.concat(F.lit("no metadata for record "), field("id"))).cast("string")), TEXT)


@variable("opt_meta", args=(1, 2))
def _opt_meta(ctx: Context, column: Value, file: Value | None = None) -> Value:
    return Value(meta_column(ctx, column, file), TEXT)


@variable("has_meta", args=(0, 1))
def _has_meta(ctx: Context, file: Value | None = None) -> Value:
    i = constant(file, 1, int) - 1
    if not 0 <= i < len(ctx.meta):
        raise ExpressionError(f"there is no metadata source {i + 1}")
    return Value(F.col(f"_meta{i}_has"), BOOL)


@variable("num", args=(1, 1))
def _num(ctx: Context, x: Value) -> Value:
    return x if x.kind in (INT, NUM) else Value(numbers.parse_number(x.text()), NUM)


@variable("bin", args=(1, 2))
def _bin(ctx: Context, x: Value, width: Value | None = None) -> Value:
    n = _num(ctx, x).col.cast("double")
    w = F.lit(1.0) if width is None else _num(ctx, width).col.cast("double")
    return Value(numbers.bin_start(n, w), BIN, w)
