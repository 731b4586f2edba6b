"""Records that are copies but for white space, case, punctuation and order of fields.

The canonical bytes of a record are its letters of ``seq`` (upper case), its heading and
its sorted set of fields. Buckets are prefixes of these bytes: a bucket of more than
``capacity`` partial counts is split by further bytes (8, 16, 32, ... bytes) until each
fits or its bytes are used up. Each bucket is counted in one trie with terminal counters.

Skew: before anything is shuffled each task counts its own rows in tries of a bounded
number of rows, so that a key with a third of all rows arrives as one partial count per
``run_rows`` rows. Members leave by a join on the digest of the bytes, never through the
bucket, so a bucket's size depends on its distinct keys and not on the number of copies.

Nulls: a record with null or empty ``seq`` or ``descr`` takes no part; a null id is kept out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

#: Keys that begin a field of a description.
FIELD_KEYS = ("tile", "x", "y", "size", "site", "primer", "depth", "buffer", "plate")
EDGE = 24


class Trie:
    """Counts byte strings; an edge holds up to EDGE bytes, a terminal a list [first, count, members]."""

    __slots__ = ("root", "size")

    def __init__(self) -> None:
        self.root: dict = {}
        self.size = 0

    def terminal(self, key: bytes) -> list:
        node = self.root
        n = len(key)
        i = EDGE
        while i < n:
            edge = key[i - EDGE : i]
            nxt = node.get(edge)
            if nxt is None:
                nxt = node[edge] = {}
            node = nxt
            i += EDGE
        # the last edge is shorter or marked, so it can't be mixed up with an inner one
        edge = (key[i - EDGE :],)
        t = node.get(edge)
        if t is None:
            t = node[edge] = [None, 0, []]
            self.size += 1
        return t

    def terminals(self) -> Iterator[tuple[bytes, list]]:
        todo = [(b"", self.root)]
        while todo:
            prefix, node = todo.pop()
            for edge, x in node.items():
                if isinstance(edge, tuple):
                    yield prefix + edge[0], x
                else:
                    todo.append((prefix + edge, x))


def canonical(seq: Column, descr: Column, keys: tuple[str, ...] = FIELD_KEYS) -> Column:
    """Canonical text: letters of seq, heading, sorted distinct fields; separated by \\x1f and \\x1e."""
    junk = "[^\\p{L}\\p{N}]"
    mark = "(?i)(^|" + junk + ")(" + "|".join(keys) + ")[\\s\\p{Z}]*(?::=|=|:)"
    parts = F.split(F.regexp_replace(F.translate(descr, "\x01\x02", "  "), mark, "\x01$2\x02"), "\x01")
    plain = lambda c: F.regexp_replace(F.lower(c), junk, "")
    field = lambda p: F.concat(F.lower(F.substring_index(p, "\x02", 1)), F.lit("="), plain(F.substring_index(p, "\x02", -1)))
    # no array is longer; its own size would split the text a second time
    fields = F.transform(F.slice(parts, 2, (1 << 31) - 16), field)
    return F.concat_ws("\x1f", F.upper(F.regexp_replace(seq, "[^\\p{L}]", "")), plain(F.element_at(parts, 1)), F.concat_ws("\x1e", F.array_sort(F.array_distinct(fields))))


PARTIAL = pa.schema([("canon", pa.binary()), ("first_no", pa.int64()), ("n", pa.int64()), ("members", pa.list_(pa.int64()))])


def _partial_counts(run_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, rows = Trie(), 0
        for b in batches:
            for no, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                trie.terminal(key)[2].append(no)
            rows += b.num_rows
            if rows >= run_rows:
                yield from _emit(trie)
                trie, rows = Trie(), 0
        yield from _emit(trie)

    def _emit(trie: Trie) -> Iterator[pa.RecordBatch]:
        at: list = []
        for key, t in trie.terminals():
            at.append((key, t[2]))
            if len(at) == 20_000:
                yield _batch(at)
                at = []
        if at:
            yield _batch(at)

    def _batch(at: list) -> pa.RecordBatch:
        ms = [m for _, m in at]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in at], pa.binary()), pa.array([min(m) for m in ms], pa.int64()), pa.array([len(m) for m in ms], pa.int64()), pa.array(ms, pa.list_(pa.int64()))], schema=PARTIAL)

    return run


GROUP = pa.schema([("canon", pa.binary()), ("first_no", pa.int64()), ("copies", pa.int64())])


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; one bucket's trie is in memory at a time."""
    trie, at, out = Trie(), None, []

    def close() -> None:
        out.extend((k, t[0], t[1]) for k, t in trie.terminals())

    def batch() -> pa.RecordBatch:
        ks, fs, ns = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(ks, pa.binary()), pa.array(fs, pa.int64()), pa.array(ns, pa.int64())], schema=GROUP)

    for b in batches:
        for bucket, key, first, n in zip(*(b.column(i).to_pylist() for i in range(4))):
            if bucket != at:
                close()
                trie, at = Trie(), bucket
            t = trie.terminal(key)
            t[1] += n
            if t[0] is None or first < t[0]:
                t[0] = first
        if len(out) >= 10_000:
            yield batch()
            out.clear()
    close()
    if out:
        yield batch()


def radix_buckets(partials: DataFrame, capacity: int, first_bytes: int = 8) -> DataFrame:
    """Adds ``bucket``: the shortest prefix of ``canon``, of first_bytes * 2**k bytes, whose bucket fits.

    Each level counts only rows of buckets still too large, all of them. The tables of
    oversized prefixes have at most rows / capacity rows; Catalyst broadcasts or shuffles
    them by their size.
    """
    df = partials.withColumn("bucket", F.substring("canon", 1, first_bytes))
    width = first_bytes
    while True:
        large = stage(df.where(F.length("canon") > width).where(F.length("bucket") == width).groupBy("bucket").count().where(F.col("count") > capacity).select("bucket"), "oversized")
        if not large.head(1):
            return df
        df = df.join(large.withColumn("too_large", F.lit(True)), "bucket", "left").withColumn("bucket", F.when(F.col("too_large"), F.substring("canon", 1, 2 * width)).otherwise(F.col("bucket"))).drop("too_large")
        width *= 2


def copy_groups(records: DataFrame, id_col: str = "rec_no", seq_col: str = "seq", descr_col: str = "descr", keys: tuple[str, ...] = FIELD_KEYS, capacity: int = 200_000, run_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(groups, partials): groups has digest, first_no, copies of each distinct record; partials has digest, members.

    An empty table gives no groups. Ids needn't be unique: a repeated id counts each time.
    """
    seq, descr = F.col(seq_col), F.col(descr_col)
    keyed = records.where(F.col(id_col).isNotNull() & (seq != "") & (descr != "")).select(F.col(id_col).cast("bigint").alias("no"), F.encode(canonical(seq, descr, keys), "UTF-8").alias("canon"))
    partials = stage(keyed.mapInArrow(_partial_counts(run_rows), "canon binary, first_no bigint, n bigint, members array<bigint>"), "copies")
    buckets = radix_buckets(partials.select("canon", "first_no", "n"), capacity)
    tries = buckets.select("bucket", "canon", "first_no", "n").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_counts, "canon binary, first_no bigint, copies bigint")
    digest = F.unhex(F.md5("canon")).alias("digest")
    return tries.select(digest, "first_no", "copies"), partials.select(digest, "members")


def copies_found(records: DataFrame, id_col: str = "rec_no", salts: int | None = None, heavy: int = 100, **options) -> DataFrame:
    """(first_<id>, <id>) of each record but the first of its copies; ids are unique.

    Members come as one row per task run. Runs with more than ``heavy`` members of a key
    are salted and the one row of a group so large is repeated for each salt, so a hot
    group spreads over tasks; there are as many salts as shuffle partitions, 16 at least.
    """
    salts = salts or max(16, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups, partials = copy_groups(records, id_col, **options)
    salt_of = F.when(F.size("members") > heavy, F.pmod(F.xxhash64(F.element_at("members", 1)), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    all_salts = F.when(F.col("copies") > heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    many = groups.where("copies > 1").select("digest", "first_no", F.explode(all_salts).alias("salt"))
    out = f"first_{id_col}"
    joined = partials.withColumn("salt", salt_of).join(many, ["digest", "salt"]).select(F.col("first_no").alias(out), F.explode("members").alias(id_col))
    return joined.where(F.col(out) != F.col(id_col))
