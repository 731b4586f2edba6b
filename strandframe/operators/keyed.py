"""Operators on keys and on two inputs: unique, compare, metadata, interleave, concat, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lang.template import compile_keys, compile_template
from ..lang.values import INT, TEXT, Value
from ..lang.variables import Context
from .basic import number_records


def _normal(v: Value) -> Column:
    """A key as a column in which whole and other numbers are equal, and undefined equals undefined."""
    return v.col.cast("double") if v.kind == "int" else v.col


def unique(df: DataFrame, keys: str | list[str], with_list: bool = False, ctx: Context | None = None) -> DataFrame:
    """The first record of each key with ``n_duplicates``, the record itself included, and ``key``.

    Keys are combined on the map side first (min_by keeps one record a key and task). ``duplicates_list``, the ids in
    input order, is only made where asked for, as it grows with its group.
    """
    vs = compile_keys(ctx or Context(), keys)
    cols = [c for c in df.columns]
    lists = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_ord", "id"))), lambda x: x["id"]), ",").alias("duplicates_list")] if with_list else []
    shown = F.concat_ws(",", *(v.printed() for v in vs))
    grouped = df.withColumn("_printed", shown).groupBy(*(_normal(v).alias(f"_k{i}") for i, v in enumerate(vs)))
    out = grouped.agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in cols), "_printed"), "_ord").alias("_first"), F.count(F.lit(1)).alias("n_duplicates"), *lists)
    return out.select(*(F.col("_first").getField(c).alias(c) for c in cols), F.col("_first").getField("_printed").alias("key"), "n_duplicates", *(["duplicates_list"] if with_list else []))


def _rest(items: Column) -> Column:
    """All but the first item, however many there are."""
    return F.slice(items, F.lit(2), F.size(items))


def unique_context(ctx: Context | None = None) -> Context:
    """A context for templates over the result of ``unique``."""
    ctx = ctx or Context()

    def own(v: Value | None) -> bool:
        return v is None or v.const in (True, "true")

    ctx.extra |= {
        "key": lambda c: Value(F.col("key"), TEXT),
        "n_duplicates": lambda c, me=None: Value(F.col("n_duplicates") - (0 if own(me) else 1), INT),
        "duplicates_list": lambda c, me=None: Value(F.col("duplicates_list") if own(me) else F.array_join(_rest(F.split("duplicates_list", ",")), ","), TEXT),
    }
    return ctx


def unique_map(df: DataFrame, keys: str | list[str], fmt: str = "long", ctx: Context | None = None) -> DataFrame:
    """The map of ids to the id kept for them. Formats: long, long-star (id, ref); wide, wide-comma, wide-key (value)."""
    vs = compile_keys(ctx or Context(), keys)
    shown = F.concat_ws(",", *(v.printed() for v in vs))
    if fmt in ("long", "long-star"):
        # the kept id is joined back from one row a key, so no window sorts a hot key in one task
        ks = [f"_k{i}" for i in range(len(vs))]
        keyed = df.select("id", "_ord", *(_normal(v).alias(k) for v, k in zip(vs, ks)))
        first = keyed.groupBy(*ks).agg(F.min_by("id", "_ord").alias("ref"), F.min("_ord").alias("_first"))
        right = first.withColumnsRenamed({k: f"_r{k}" for k in ks})
        cond = None
        for k in ks:
            c = keyed[k].eqNullSafe(right[f"_r{k}"])
            cond = c if cond is None else cond & c
        ref = F.col("ref") if fmt == "long" else F.when(F.col("_ord") == F.col("_first"), "*").otherwise(F.col("ref"))
        return keyed.join(right, cond).orderBy("_first", "_ord").select("id", ref.alias("ref"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_ord", "id"))), lambda x: x["id"])
    g = df.withColumn("_printed", shown).groupBy(*(_normal(v).alias(f"_k{i}") for i, v in enumerate(vs))).agg(ids.alias("_ids"), F.min("_ord").alias("_first"), F.min_by("_printed", "_ord").alias("_key"))
    value = {
        "wide": F.array_join("_ids", "\t"),
        "wide-comma": F.concat(F.element_at("_ids", 1), F.lit("\t"), F.array_join("_ids", ",")),
        "wide-key": F.concat(F.col("_key"), F.lit("\t"), F.array_join("_ids", "\t")),
    }[fmt]
    return g.orderBy("_first").select(value.alias("value"))


def _keyed(df: DataFrame, keys: str | list[str], ctx: Context | None, side: str) -> tuple[DataFrame, list[str]]:
    vs = compile_keys(ctx or Context(), keys)
    names = [f"_{side}{i}" for i in range(len(vs))]
    return df.select(*(F.col(f"`{c}`") for c in df.columns), *(_normal(v).alias(n) for v, n in zip(vs, names))), names


def _same(a: list[str], b: list[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def _occurrences(df: DataFrame, keys: list[str], name: str, spans: int = 1024) -> DataFrame:
    """Adds the number of each row among those of its key, by ``_ord``.

    Rows are numbered within spans of ``_ord``, and spans by their counts, so a key that holds most of the rows is many tasks.
    """
    bounds = df.agg(F.min("_ord").alias("_lo"), F.max("_ord").alias("_hi"))
    lo, hi = bounds.select("_lo").scalar(), bounds.select("_hi").scalar()
    width = F.greatest(F.lit(1), F.ceil((hi - lo + 1) / F.lit(spans)).cast("bigint"))
    x = df.withColumn("_span", F.floor((F.col("_ord") - lo) / width))
    counts = x.groupBy(*keys, "_span").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_span")) - F.col("_n")).select(*(F.col(k).alias(f"_b{k}") for k in keys), F.col("_span").alias("_bspan"), "_before")
    row = F.row_number().over(Window.partitionBy(*keys, "_span").orderBy("_ord"))
    numbered = x.withColumn("_row", row).join(before, _same([*keys, "_span"], [*(f"_b{k}" for k in keys), "_bspan"]))
    return numbered.withColumn(name, F.col("_before") + F.col("_row")).drop("_row", "_before", "_bspan", "_span", *(f"_b{k}" for k in keys))


def compare(left: DataFrame, right: DataFrame, keys: str | list[str] = "id,seqhash", unordered_duplicates: bool = False, ctx: Context | None = None) -> DataFrame:
    """Full outer comparison: ``category`` (common, unique1, unique2) and ``key``, as printed, with both sides' id, seq and ``_ord``.

    A key that occurs twice on a side is an error; with ``unordered_duplicates`` the n-th occurrences of a key
    on both sides belong together. Undefined keys are equal to each other.
    """
    shown = lambda: F.concat_ws(",", *(v.printed() for v in compile_keys(ctx or Context(), keys)))
    a, ka = _keyed(left.withColumn("_key", shown()), keys, ctx, "a")
    b, kb = _keyed(right.withColumn("_key", shown()), keys, ctx, "b")

    def side(df: DataFrame, ks: list[str], s: str) -> DataFrame:
        fields = [F.col(c).alias(f"{c}{s}") for c in ("id", "seq", "_ord", "_key")]
        if unordered_duplicates:
            return _occurrences(df, ks, f"_n{s}").select(*ks, f"_n{s}", *fields)
        one = df.select(*ks, F.struct(*fields).alias("_f")).groupBy(*ks).agg(F.first("_f").alias("_f"), F.count(F.lit(1)).alias("_c"))
        number = F.when(F.col("_c") > 1, F.raise_error(F.concat(F.lit("key occurs twice: "), F.col(f"_f.id{s}"))).cast("int")).otherwise(1)
        return one.select(*ks, number.alias(f"_n{s}"), "_f.*")

    j = side(a, ka, "1").join(side(b, kb, "2"), _same([*ka, "_n1"], [*kb, "_n2"]), "full_outer")
    category = F.when(F.col("_ord2").isNull(), "unique1").when(F.col("_ord1").isNull(), "unique2").otherwise("common")
    return j.select("id1", "seq1", "_ord1", "id2", "seq2", "_ord2", category.alias("category"), F.when(category == "common", "c").otherwise(F.regexp_replace(category, "nique", "")).alias("category_short"), F.coalesce("_key1", "_key2").alias("key"))


def compare_stats(left: DataFrame, right: DataFrame, keys: str | list[str] = "id,seqhash", ctx: Context | None = None) -> DataFrame:
    """(category, n), each category present."""
    n = compare(left, right, keys, ctx=ctx).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    all3 = left.sparkSession.createDataFrame([("common",), ("unique1",), ("unique2",)], "category string")
    return all3.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def intersect(left: DataFrame, right: DataFrame, keys: str | list[str] = "id,seqhash", ctx: Context | None = None, how: str = "left_semi") -> DataFrame:
    """Records of ``left`` whose key is in ``right``; how='left_anti': isn't."""
    a, ka = _keyed(left, keys, ctx, "a")
    b, kb = _keyed(right, keys, ctx, "b")
    return a.join(b.select(*kb).distinct(), _same(ka, kb), how).drop(*ka)


def difference(left: DataFrame, right: DataFrame, keys: str | list[str] = "id,seqhash", ctx: Context | None = None) -> DataFrame:
    return intersect(left, right, keys, ctx, "left_anti")


def is_equal(left: DataFrame, right: DataFrame, keys: str | list[str] = "id,seqhash") -> bool:
    return not difference(left, right, keys).head(1) and not difference(right, left, keys).head(1)


def with_meta(df: DataFrame, *sources: DataFrame, id_col: str | int = 0, ctx: Context | None = None) -> tuple[DataFrame, Context]:
    """Records with the values of side tables, and a context in which meta, opt_meta and has_meta find them.

    The first row of an id counts, by ``_ord`` where the source has it. Catalyst broadcasts a source by its size.
    """
    ctx = ctx or Context()
    ctx.meta = []
    for i, m in enumerate(sources):
        names = [c for c in m.columns if c != "_ord"]
        key = id_col if isinstance(id_col, str) else names[id_col]
        text = m.select(*(F.col(f"`{c}`").cast("string").alias(f"_meta{i}_{k}") for k, c in enumerate(names)), F.col(f"`{key}`").cast("string").alias("_mid"), (F.col("_ord") if "_ord" in m.columns else F.lit(0)).alias("_mord")).where(F.col("_mid").isNotNull())
        first = text.groupBy("_mid").agg(F.min_by(F.struct(*(c for c in text.columns if c.startswith("_meta"))), "_mord").alias("_m")).select("_mid", "_m.*", F.lit(True).alias("_has"))
        df = df.join(first, F.col("id") == F.col("_mid"), "left").withColumn(f"_meta{i}_has", F.coalesce("_has", F.lit(False))).drop("_mid", "_has")
        ctx.meta.append(names)
    return df, ctx


def has_meta(df: DataFrame, source: DataFrame, id_col: str, how: str = "left_semi") -> DataFrame:
    """Records with an id in ``source``; how='left_anti': without."""
    return df.join(source.select(F.col(f"`{id_col}`").cast("string").alias("_mid")).distinct(), F.col("id") == F.col("_mid"), how)


def _zipped(inputs: tuple[DataFrame, ...], check_ids: bool) -> DataFrame:
    """One row a position with the records of all inputs as ``_r0``, ``_r1`` ...; unequal numbers of records are an error."""
    out = None
    for i, df in enumerate(inputs):
        x = number_records(df).select("_num", F.struct(F.col("id").alias("id"), F.col("desc").alias("desc"), F.col("seq").alias("seq"), F.col("qual").alias("qual")).alias(f"_r{i}"))
        out = x if out is None else out.join(x, "_num", "full_outer")
    bad = F.lit(False)
    for i in range(len(inputs)):
        bad = bad | F.col(f"_r{i}").isNull()
    out = out.withColumn("_num", F.when(bad, F.raise_error(F.lit("the inputs differ in their number of records")).cast("bigint")).otherwise(F.col("_num")))
    if check_ids:
        differ = F.lit(False)
        for i in range(1, len(inputs)):
            differ = differ | (F.col(f"_r{i}.id") != F.col("_r0.id"))
        out = out.withColumn("_num", F.when(differ, F.raise_error(F.concat(F.lit("ids differ: "), F.col("_r0.id"))).cast("bigint")).otherwise(F.col("_num")))
    return out


def interleave(*inputs: DataFrame, check_ids: bool = True) -> DataFrame:
    """The records of all inputs in turn, joined by position."""
    z = _zipped(inputs, check_ids)
    n = len(inputs)
    x = z.select("_num", F.posexplode(F.array(*(F.col(f"_r{i}") for i in range(n)))).alias("_i", "_r"))
    return x.select("_r.id", "_r.desc", "_r.seq", "_r.qual", ((F.col("_num") - 1) * n + F.col("_i")).alias("_ord"))


def concat(*inputs: DataFrame, check_ids: bool = True, spacer: int = 0, char: str = "N", qual_char: str = "I") -> DataFrame:
    """Records of the same position joined into one, with a spacer between; id and desc of the first input."""
    z = _zipped(inputs, check_ids)
    n = len(inputs)
    seq = F.array_join(F.array(*(F.col(f"_r{i}.seq") for i in range(n))), char * spacer)
    no_qual = F.lit(False)
    for i in range(n):
        no_qual = no_qual | F.col(f"_r{i}.qual").isNull()
    qual = F.when(no_qual, None).otherwise(F.array_join(F.array(*(F.col(f"_r{i}.qual") for i in range(n))), qual_char * spacer))
    return z.select("_r0.id", "_r0.desc", seq.alias("seq"), qual.alias("qual"), F.col("_num").alias("_ord"))


def split_paths(df: DataFrame, template: str | None = None, chunk: int | None = None, ctx: Context | None = None) -> DataFrame:
    """Records with ``_out``, the path they are written to; {chunk} numbers runs of ``chunk`` records."""
    ctx = ctx or Context()
    if chunk:
        df = number_records(df)
        ctx.extra["chunk"] = lambda c: Value((F.floor((F.col("_num") - 1) / chunk) + 1).cast("bigint"), INT)
    return df.withColumn("_out", compile_template(ctx, template).printed())


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("_out").alias("path")).agg(F.count(F.lit(1)).alias("n"))
