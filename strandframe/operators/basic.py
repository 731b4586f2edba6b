"""Record operators that are plain Catalyst expressions: DataFrame of records in, DataFrame out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence
from ..lang.js import compile_filter
from ..lang.ranges import Range, change, cut, parse_ranges
from ..lang.template import compile_keys, compile_template, split_list
from ..lang.values import TEXT, UNDEFINED, ExpressionError, Value
from ..lang.variables import Context, without_deleted
from ..model import FIELDS
from ..session import stage

INTERNAL = {*FIELDS, "_num", "_file_num", "_input", "_path"}


def number_records(df: DataFrame, spans: int = 1024) -> DataFrame:
    """Adds ``_num``, the 1-based number in the input order, and ``_file_num``, that within each input.

    Rows are counted in spans of ``_ord`` and numbered within their span, so no task gets more than a span;
    the offsets are a table of at most ``spans`` rows an input.
    """
    own = "_input" in df.columns
    x = df if own else df.withColumn("_input", F.lit(0))
    bounds = x.groupBy("_input").agg(F.min("_ord").alias("_lo"), F.max("_ord").alias("_hi"))
    width = F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.lit(spans)).cast("bigint"))
    x = x.join(bounds, "_input").withColumn("_span", F.floor((F.col("_ord") - F.col("_lo")) / width)).drop("_lo", "_hi")
    counts = x.groupBy("_input", "_span").agg(F.count(F.lit(1)).alias("_n"))
    before = lambda w: F.sum("_n").over(w) - F.col("_n")
    # the numbers before an input need one row an input, those before a span the rows of its input
    inputs = counts.groupBy("_input").agg(F.sum("_n").alias("_n")).select("_input", before(Window.orderBy("_input")).alias("_before"))
    offsets = counts.select("_input", "_span", before(Window.partitionBy("_input").orderBy("_span")).alias("_in_file")).join(inputs, "_input").select("_input", "_span", "_in_file", (F.col("_before") + F.col("_in_file")).alias("_in_all"))
    row = F.row_number().over(Window.partitionBy("_input", "_span").orderBy("_ord"))
    out = x.withColumn("_row", row).join(offsets, ["_input", "_span"]).withColumn("_num", F.col("_in_all") + F.col("_row")).withColumn("_file_num", F.col("_in_file") + F.col("_row"))
    return out.drop("_span", "_row", "_in_file", "_in_all", *([] if own else ["_input"]))


def stat(df: DataFrame, variables: str | list[str], ctx: Context | None = None, names: list[str] | None = None) -> DataFrame:
    """id and each variable, typed; ``names`` renames the columns."""
    ctx = ctx or Context()
    vs = split_list(variables) if isinstance(variables, str) else variables
    return df.select("id", *(_shown(compile_template(ctx, v, raw=True)).alias((names or vs)[i]) for i, v in enumerate(vs)))


def _shown(v: Value) -> Column:
    return v.text() if v.kind == "bin" else v.col


def table(df: DataFrame, fields: str | list[str], ctx: Context | None = None) -> DataFrame:
    """One text column ``value`` a record, as a delimited writer prints it; undefined values by that word."""
    return df.select(*(compile_template(ctx or Context(), f, raw=True).printed().alias(f"_{i}") for i, f in enumerate(split_list(fields) if isinstance(fields, str) else fields)))


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def count_by(df: DataFrame, keys: str | list[str], ctx: Context | None = None, limit: int = 1_000_000, names: list[str] | None = None) -> DataFrame:
    """Counts by the printed keys, in the order of their values; more than ``limit`` categories are an error. No rows for no input."""
    vs = compile_keys(ctx or Context(), keys)
    names = names or [f"key{i + 1}" if len(vs) > 1 else "key" for i in range(len(vs))]
    # rows are counted by the values themselves, only groups are printed; values that print alike are one category
    native = [[c.alias(f"_o{i}_{j}") for j, c in enumerate(v.sort_columns())] for i, v in enumerate(vs)]
    flat = [c for own in native for c in own]
    counted = df.select(*flat).groupBy(*(f"_o{i}_{j}" for i, own in enumerate(native) for j in range(len(own)))).agg(F.count(F.lit(1)).alias("_n"))
    values = [Value(F.col(f"_o{i}_0"), v.kind, F.col(f"_o{i}_1") if v.kind == "bin" else None) for i, v in enumerate(vs)]
    counts = counted.groupBy(*(v.printed().alias(n) for v, n in zip(values, names))).agg(F.sum("_n").alias("n"), *(F.min(c).alias(c) for c in counted.columns if c != "_n"))
    if limit:
        # the counts are reused, the subquery reads at most one row more than allowed
        n = counts.limit(limit + 1).agg(F.count(F.lit(1)).alias("_c"))
        too_many = n.select(F.when(F.col("_c") > limit, F.raise_error(F.lit(f"more than {limit} categories")).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        counts = counts.where(F.col("n") > too_many.scalar())
    return counts.orderBy(*(F.asc_nulls_last(c) for c in counts.columns if c.startswith("_o"))).select(*names, "n")


def head(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy("_ord").limit(n)


def tail(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc("_ord")).limit(n).orderBy("_ord")


def slice_records(df: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Records start to end, counted from 1, both included. Zero and negative bounds are an error."""
    if (start is not None and start < 1) or (end is not None and end < 1):
        raise ValueError("bounds of a slice start at 1")
    a = start or 1
    if end is not None:
        # the rows up to the end are a top-k; those before the start are dropped from it
        return df.orderBy("_ord").limit(end).orderBy("_ord").offset(a - 1)
    return number_records(df).where(F.col("_num") >= a).drop("_num", "_file_num")


def _draw(seed: int) -> Column:
    """A number below 2**32 from the record's place and the seed; any engine can compute it."""
    return F.conv(F.substr(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_ord").cast("string"))), F.lit(1), F.lit(8)), 16, 10).cast("bigint")


def sample_n(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n records, all if there are fewer, in input order; the same for the same seed."""
    return df.orderBy(_draw(seed), "_ord").limit(n).orderBy("_ord")


def sample_share(df: DataFrame, p: float, seed: int = 0) -> DataFrame:
    """Each record with the chance p."""
    if not 0 <= p < 1:
        raise ValueError("a share is at least 0 and less than 1")
    return df.where(_draw(seed) < int(p * (1 << 32)))


def sort(df: DataFrame, keys: str | list[str], reverse: bool = False, ctx: Context | None = None) -> DataFrame:
    """Stable: ties stay in input order, also reversed. Undefined keys come last, reversed first."""
    cols = [c for v in compile_keys(ctx or Context(), keys) for c in v.sort_columns()]
    return df.orderBy(*(F.desc_nulls_first(c) if reverse else F.asc_nulls_last(c) for c in cols), "_ord")


def with_key(df: DataFrame, keys: str | list[str], ctx: Context | None = None) -> tuple[DataFrame, Context]:
    """Records with ``_key``, the printed key that they are sorted or compared by, and a context in which ``key`` reads it."""
    ctx = ctx or Context()
    out = df.withColumn("_key", F.concat_ws(",", *(v.printed() for v in compile_keys(ctx, keys))))
    ctx.extra["key"] = lambda c: Value(F.col("_key"), TEXT)
    return out, ctx


def sort_ranks(df: DataFrame, keys: str | list[str], reverse: bool = False, ctx: Context | None = None) -> DataFrame:
    """All records with ``_rank``, the 1-based place in ``sort``. They are sorted in ranges over all tasks and written once, ranks need one count a task."""
    s = stage(sort(df, keys, reverse, ctx).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    s = s.withColumn("_task", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = s.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_before"))
    return s.join(F.broadcast(before), "_task").withColumn("_rank", F.col("_before") + F.col("_row") + 1).drop("_at", "_task", "_row", "_before")


def filter_records(df: DataFrame, expression: str, ctx: Context | None = None) -> DataFrame:
    ctx = ctx or Context()
    kept = df.where(compile_filter(ctx, expression).truth())
    return _changed(kept, ctx, {}) if ctx.deleted else kept


def filter_dropped(df: DataFrame, expression: str, ctx: Context | None = None) -> DataFrame:
    return df.where(~compile_filter(ctx or Context(), expression).truth())


def set_fields(df: DataFrame, id: str | None = None, desc: str | None = None, seq: str | None = None, ctx: Context | None = None) -> DataFrame:
    """Fields replaced by templates; qual stays as it is. Attributes that attr_del names leave the fields that aren't replaced."""
    ctx = ctx or Context()
    new = {f: compile_template(ctx, t).printed() for f, t in (("id", id), ("desc", desc), ("seq", seq)) if t is not None}
    return _changed(df, ctx, new) if new else df


def _changed(df: DataFrame, ctx: Context, new: dict[str, Column]) -> DataFrame:
    """``df`` with new columns, and without the attributes that their expressions have taken out."""
    if ctx.deleted:
        i, d = without_deleted(ctx, F.col("id"), F.col("desc"))
        new = {"id": i, "desc": d} | new
    return df.withColumns(new)


def delete(df: DataFrame, desc: bool = False, attrs: list[str] | None = None, ctx: Context | None = None) -> DataFrame:
    ctx = ctx or Context()
    if desc:
        return df.withColumn("desc", F.lit(None).cast("string"))
    i, d = ctx.attr_format.delete(attrs or [], F.col("id"), F.col("desc"))
    return df.withColumns({"id": i, "desc": d})


def set_attrs(df: DataFrame, edit: dict[str, str] | None = None, append: dict[str, str] | None = None, ctx: Context | None = None) -> DataFrame:
    """Attributes replaced where they stand, or appended; ``append`` always appends. One name can't be in both."""
    ctx = ctx or Context()
    edit, append = edit or {}, append or {}
    if set(edit) & set(append):
        raise ExpressionError(f"attributes both edited and appended: {sorted(set(edit) & set(append))}")
    values = {n: compile_template(ctx, t).printed() for n, t in {**edit, **append}.items()}
    i, d = without_deleted(ctx, F.col("id"), F.col("desc"))
    for n in edit:
        i, d = ctx.attr_format.edit(n, values[n], i, d)
    for n in append:
        i, d = ctx.attr_format.append(n, values[n], i, d)
    return df.withColumns({"id": i, "desc": d})


def _ranges(ranges: str | list[Range], ctx: Context) -> list[Range]:
    if not isinstance(ranges, str):
        return ranges
    if "{" not in ranges:
        return parse_ranges(ranges)
    out = []
    for r in split_list(ranges):
        parts = split_list(r, ":")
        bound = lambda t: None if t.strip() in ("", UNDEFINED) else compile_template(ctx, t).number() if "{" in t else int(t)
        if len(parts) == 2:
            ends = [bound(p) for p in parts]
            out.append(Range(*(F.when(F.isnan(e), None).otherwise(e.cast("int")) if isinstance(e, Column) else e for e in ends)))
            continue
        text = compile_template(ctx, r).text()
        side = lambda k: F.nullif(F.nullif(F.element_at(F.split(text, ":"), k), F.lit("")), F.lit(UNDEFINED)).cast("int")  # noqa: E731, B023
        out.append(Range(side(1), side(2)))
    return out


def trim(df: DataFrame, ranges: str | list[Range], exclusive: bool = False, zero_based: bool = False, ctx: Context | None = None) -> DataFrame:
    """seq and qual cut to the ranges, joined in the given order."""
    ctx = ctx or Context()
    rs = _ranges(ranges, ctx)
    return _changed(df, ctx, {"seq": cut(F.col("seq"), rs, exclusive, zero_based), "qual": cut(F.col("qual"), rs, exclusive, zero_based)})


def mask(df: DataFrame, ranges: str | list[Range], hard: str | None = None, unmask: bool = False, exclusive: bool = False, zero_based: bool = False, ctx: Context | None = None) -> DataFrame:
    """Ranges in lower case, in upper case, or overwritten by one character; qual stays."""
    if hard is not None and len(hard) != 1:
        raise ValueError("a mask is one character")
    how = (lambda c: F.repeat(F.lit(hard), F.length(c))) if hard else sequence.ascii_upper if unmask else sequence.ascii_lower
    ctx = ctx or Context()
    return _changed(df, ctx, {"seq": change(F.col("seq"), _ranges(ranges, ctx), how, exclusive, zero_based)})


def upper(df: DataFrame) -> DataFrame:
    return df.withColumn("seq", sequence.ascii_upper(F.col("seq")))


def lower(df: DataFrame) -> DataFrame:
    return df.withColumn("seq", sequence.ascii_lower(F.col("seq")))


def revcomp(df: DataFrame, seqtype: str = "auto", strict: bool = False) -> DataFrame:
    return df.withColumns({"seq": sequence.reverse_complement(F.col("seq"), seqtype, strict), "qual": F.reverse("qual")})


def replace(df: DataFrame, pattern: str, replacement: str, field: str = "seq", regex: bool = False) -> DataFrame:
    """All non-overlapping occurrences; with ``regex`` the replacement may hold $1 and ${name}."""
    c = F.col(field)
    if regex:
        rep = re.sub(r"\$([A-Za-z]\w*)", r"${\1}", replacement)
        return df.withColumn(field, F.regexp_replace(c, pattern, rep))
    return df.withColumn(field, F.replace(c, F.lit(pattern), F.lit(replacement)))
