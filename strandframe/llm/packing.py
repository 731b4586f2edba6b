"""Texts of varying length placed in containers of fixed capacity.

Only the number of texts of each size decides a packing, so the packing is planned on the
histogram of sizes (at most ``capacity`` numbers, whatever the input) and the texts then find
their place by their rank among texts of their size:

1. sizes above a third of the capacity are matched greedily, two a container at most, each
   with the largest that still fits;
2. smaller sizes, the larger first, go into the smallest gap that holds them; new containers are
   opened where no gap does.

Ranks come from counts by (size, salt) and row numbers within these, so a size that a third of
all texts share spreads over tasks. Only a text larger than the capacity is split: its full parts take
whole containers, its last part is packed like any other text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .encode import TOKENIZER, count_ids


class Plan:
    """Runs of ranks: the items of ``size`` with ranks from ``rank`` on lie ``each`` a container from ``container`` and ``offset`` on."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.left, self.used = capacity, dict(counts), dict.fromkeys(counts, 0)
        self.runs: list[tuple[int, int, int, int, int]] = []  # size, rank, container, offset, each
        self.containers = 0
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first container, number of containers)
        self._match_large()
        self._fit_small()

    def _put(self, size: int, first: int, many: int, offset: int, each: int, items: int | None = None) -> None:
        items = many * each if items is None else items
        self.runs.append((size, self.used[size], first, offset, each))
        self.used[size] += items
        self.left[size] -= items

    def _open(self, many: int) -> int:
        self.containers += many
        return self.containers - many

    def _gap(self, gap: int, first: int, many: int) -> None:
        if many and gap:
            self.gaps.setdefault(gap, []).append((first, many))

    def _match_large(self) -> None:
        large = sorted((s for s in self.left if 3 * s > self.capacity), reverse=True)
        for i, a in enumerate(large):
            for b in large[i:]:
                if not self.left[a]:
                    break
                if a + b > self.capacity or not self.left[b]:
                    continue
                many = self.left[a] // 2 if a == b else min(self.left[a], self.left[b])
                if not many:
                    continue
                first = self._open(many)
                self._put(a, first, many, 0, 1)
                self._put(b, first, many, a, 1)
                self._gap(self.capacity - a - b, first, many)
            if many := self.left[a]:
                first = self._open(many)
                self._put(a, first, many, 0, 1)
                self._gap(self.capacity - a, first, many)

    def _fit_small(self) -> None:
        for s in sorted((s for s in self.left if 3 * s <= self.capacity), reverse=True):
            for gap in sorted(g for g in self.gaps if g >= s):
                while self.left[s] and self.gaps.get(gap):
                    first, many = self.gaps[gap].pop()
                    self._fill(s, first, many, gap)
                if not self.gaps.get(gap):
                    self.gaps.pop(gap, None)
                if not self.left[s]:
                    break
            if self.left[s]:
                many = -(-self.left[s] // (self.capacity // s))
                self._fill(s, self._open(many), many, self.capacity)

    def _fill(self, s: int, first: int, many: int, gap: int) -> None:
        """As many of s as fit into each of these containers, until s or the containers are used up."""
        each, offset = gap // s, self.capacity - gap
        full = min(many, self.left[s] // each)
        if full:
            self._put(s, first, full, offset, each)
            self._gap(gap - each * s, first, full)
        if (rest := self.left[s]) and full < many:
            self._put(s, first + full, 1, offset, each, rest)
            self._gap(gap - rest * s, first + full, 1)
            full += 1
        self._gap(gap, first + full, many - full)


def _ranked(df: DataFrame, key: str, id_col: str, salts: int) -> DataFrame:
    """Adds ``rank`` (from 0) among rows of the same key."""
    salted = df.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int"))
    counts = salted.groupBy(key, "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(key).orderBy("salt")) - F.col("n")).drop("n")
    row = F.row_number().over(Window.partitionBy(key, "salt").orderBy(id_col)) - 1
    return salted.withColumn("row", row).join(before, [key, "salt"]).withColumn("rank", F.col("before") + F.col("row")).drop("salt", "before", "row")


def pack_sizes(sizes: DataFrame, id_col: str, capacity: int, salts: int | None = None) -> DataFrame:
    """(id, part, container, position, n_ids) of each part of each row of ``sizes`` (id, n_ids > 0); ids are unique.

    ``position`` is the place of the part's first id in its container, from 0. Rows of one size are ranked in ``salts`` pieces, as many as
    shuffle partitions and 64 at least.
    """
    salts = salts or max(64, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = sizes.where("n_ids > 0").select(id_col, "n_ids", F.expr(f"n_ids div {capacity}").alias("full"), F.expr(f"n_ids % {capacity}").alias("size"))
    items = parts.where("size > 0").select(id_col, "full", "size")
    counts = {int(r["size"]): int(r["n"]) for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    plan = Plan(counts, capacity)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    big = np.int64(1) << 44
    keys = runs[:, 0] * big + runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            r = runs[np.searchsorted(keys, size * big + rank, "right") - 1]
            k = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(r[:, 2] + k // r[:, 4]), pa.array(r[:, 3] + k % r[:, 4] * size), b.column(2)], names=[id_col, "part", "container", "position", "n_ids"])

    kind = sizes.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, part bigint, container bigint, position bigint, n_ids bigint"
    packed = _ranked(items, "size", id_col, salts).select(id_col, F.col("full").alias("part"), "size", "rank").mapInArrow(place, schema)
    large = _ranked(parts.where("full > 0").select(id_col, "full"), "full", id_col, salts)
    # texts with as many full parts follow one another; the distinct numbers of parts are few
    starts = parts.where("full > 0").groupBy("full").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.sum(F.col("n") * F.col("full")).over(Window.orderBy("full")) - F.col("n") * F.col("full")).drop("n")
    whole = large.join(starts, "full").select(id_col, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("part"), (F.lit(plan.containers) + F.col("start") + F.col("rank") * F.col("full")).alias("at"))
    whole = whole.select(id_col, "part", (F.col("at") + F.col("part")).alias("container"), F.lit(0).cast("bigint").alias("position"), F.lit(capacity).cast("bigint").alias("n_ids"))
    return packed.unionByName(whole)


def pack_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, path: str = TOKENIZER) -> DataFrame:
    """Containers of ``capacity`` ids for the texts of ``df``; null and empty texts take no part, an empty table gives no rows."""
    sizes = stage(count_ids(df.where(F.col(text_col) != ""), id_col, text_col, path), "sizes")
    return pack_sizes(sizes, id_col, capacity)
