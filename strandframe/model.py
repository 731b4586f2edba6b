"""The record: one row of id, desc, seq, qual and ``_ord``, the place of the row in its input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("id", "desc", "seq", "qual", "_ord")


def records(df: DataFrame, id: str, seq: str, desc: str | None = None, qual: str | None = None, order: str | None = None) -> DataFrame:
    """Any DataFrame as records by a mapping of columns; columns that aren't named are left out.

    ``order`` names a column that gives the input order. Without it the order is the place in the
    scan, which only one read of the same files keeps. A null id or seq reads as ''.
    """
    text = lambda c: F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")
    return df.select(
        F.coalesce(text(id), F.lit("")).alias("id"),
        text(desc).alias("desc"),
        F.coalesce(text(seq), F.lit("")).alias("seq"),
        text(qual).alias("qual"),
        (F.col(f"`{order}`").cast("bigint") if order else F.monotonically_increasing_id()).alias("_ord"),
    )


def split_header(header: Column) -> tuple[Column, Column]:
    """(id, desc): the id ends before the first space; without a space there is no desc, which isn't an empty one."""
    at = F.instr(header, " ")
    return F.substring_index(header, " ", 1), F.when(at > 0, F.substr(header, at + 1))


def union_inputs(*inputs: DataFrame) -> DataFrame:
    """Several inputs in the given order; ``_input`` is the number of each, ``_ord`` restarts in each."""
    out = None
    for i, df in enumerate(inputs):
        df = df.withColumn("_input", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
