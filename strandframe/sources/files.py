"""FASTA, FASTQ, QUAL and delimited files as records, and records as such files.

``strandframe.records`` is a Python data source: plain files are cut into byte ranges that resynchronise at
record starts, compressed ones are read whole. It yields Arrow batches with the file and the place of each record.
"""

from __future__ import annotations

import glob
import io
import itertools
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.sequence import check_quality, convert_quality, phred_list, quality_of_phred
from ..lang.template import compile_template, split_list
from ..lang.variables import Context
from ..model import FIELDS, split_header
from .formats import COMPRESSION, Format, resolve_input, resolve_output

SCHEMA = "header string, seq string, qual string, _path string, _input int, _ord bigint"
ARROW = pa.schema([("header", pa.string()), ("seq", pa.string()), ("qual", pa.string()), ("_path", pa.string()), ("_input", pa.int32()), ("_ord", pa.int64())])
SPLIT_BYTES, BATCH = 64 << 20, 5_000


@dataclass
class Piece(InputPartition):
    path: str
    number: int
    start: int
    end: int | None  # None: the whole file

    def __init__(self, path: str, number: int, start: int, end: int | None) -> None:
        self.path, self.number, self.start, self.end = path, number, start, end


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (file, hdfs, s3 and the like) and the path within it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def expand(path: str | list[str]) -> list[str]:
    """Files of paths with wildcards or folders, in the given order; marks of finished jobs left out."""
    out: list[str] = []
    hidden = lambda f: os.path.basename(f).startswith(("_", "."))
    for p in [path] if isinstance(path, str) else path:
        p = p.removeprefix("file://")
        if "://" in p:
            fs, inner = file_system(p)
            info = fs.get_file_info(inner)
            root = p[: len(p) - len(inner)] if p.endswith(inner) else p.partition("://")[0] + "://"
            out += sorted(root + f.path for f in fs.get_file_info(pafs.FileSelector(inner, recursive=True)) if f.is_file and not hidden(f.path)) if info.type == pafs.FileType.Directory else [p]
            continue
        found = sorted(glob.glob(os.path.join(p, "**"), recursive=True)) if os.path.isdir(p) else sorted(glob.glob(p)) or [p]
        out += [f for f in found if os.path.isfile(f) and not hidden(f)] if found != [p] or os.path.exists(p) else [p]
    return out


def open_file(path: str) -> io.BufferedIOBase:
    """The file's bytes without its compression."""
    fs, inner = file_system(path)
    raw = io.BufferedReader(fs.open_input_file(inner), 1 << 20)
    kind = COMPRESSION.get(path.rsplit(".", 1)[-1].lower())
    if kind == "gz":
        import gzip

        return gzip.open(raw)
    if kind == "bz2":
        import bz2

        return bz2.open(raw)
    if kind == "zstd":
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True))
    if kind == "lz4":
        return io.BufferedReader(pa.CompressedInputStream(fs.open_input_file(inner), "lz4"))
    return raw


def fasta_records(f: io.BufferedIOBase, start: int, end: int | None, glue: bytes = b"") -> Iterator[tuple[int, str, str, None]]:
    """(place, header, seq, None) of records that begin in [start, end); lines are joined, those of scores by a blank."""
    at = start
    if start:
        f.seek(start - 1)
        at = start - 1 + len(f.readline())
    header, place, lines = None, 0, []
    for line in f:
        if line.startswith(b">"):
            if header is not None:
                yield place, header, glue.join(lines).decode(), None
                header = None
            if end is not None and at >= end:
                return
            header, place, lines = line[1:].rstrip(b"\r\n").decode(), at, []
        elif header is not None:
            lines.append(line.rstrip(b"\r\n"))
        elif not start and line.strip():
            raise ValueError(f"FASTA must begin with '>', not {line[:20]!r}")
        at += len(line)
    if header is not None:
        yield place, header, glue.join(lines).decode(), None


def fastq_records(f: io.BufferedIOBase, start: int, end: int | None) -> Iterator[tuple[int, str, str, str]]:
    """(place, header, seq, qual) of records of four lines that begin in [start, end).

    A record start is a line with @ whose second next line has + and whose lengths agree.
    """
    at = start
    if start:
        f.seek(start - 1)
        at = start - 1 + len(f.readline())
        window = [f.readline() for _ in range(8)]
        skip = None
        for k in range(4):
            a, b, c, d = (x.rstrip(b"\r\n") for x in window[k : k + 4])
            if a.startswith(b"@") and c.startswith(b"+") and len(b) == len(d):
                skip = k
                break
        if skip is None:
            if all(window[:7]):
                raise ValueError(f"no FASTQ record near byte {start}")
            return  # what is left belongs to a record that begins before
        at += sum(len(x) for x in window[:skip])
        f.seek(at)
    while end is None or at < end:
        lines = [f.readline() for _ in range(4)]
        if not lines[0].strip():
            if not lines[0]:
                return
            raise ValueError("blank line in FASTQ")
        a, b, c, d = (x.rstrip(b"\r\n") for x in lines)
        if not a.startswith(b"@") or not c.startswith(b"+") or len(b) != len(d):
            raise ValueError(f"invalid FASTQ record at byte {at}: {a[:40]!r}")
        yield at, a[1:].decode(), b.decode(), d.decode()
        at += sum(map(len, lines))


class RecordReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.kind = options["kind"]
        self.paths = options["paths"].split("\n")
        self.split = int(options.get("splitbytes") or options.get("splitBytes") or SPLIT_BYTES)

    def partitions(self) -> list[Piece]:
        out = []
        for i, p in enumerate(self.paths):
            fs, inner = file_system(p)
            size = fs.get_file_info(inner).size
            if p.rsplit(".", 1)[-1].lower() in COMPRESSION or size <= self.split:
                out.append(Piece(p, i, 0, None))
            else:
                out += [Piece(p, i, a, min(size, a + self.split)) for a in range(0, size, self.split)]
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        of = fastq_records if self.kind == "fastq" else fasta_records
        rows: list[tuple] = []
        with open_file(piece.path) as f:
            for place, header, seq, qual in of(f, piece.start, piece.end, *([b" "] if self.kind == "qual" else [])):
                rows.append((header, seq, qual, piece.path, piece.number, place))
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandframe.records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(dict(self.options))


def _source(spark: SparkSession, kind: str, files: list[str], split_bytes: int) -> DataFrame:
    spark.dataSource.register(RecordSource)
    raw = spark.read.format("strandframe.records").option("kind", kind).option("paths", "\n".join(files)).option("splitBytes", str(split_bytes)).load()
    i, d = split_header(F.col("header"))
    return raw.select(i.alias("id"), d.alias("desc"), "seq", "qual", "_ord", "_input", "_path")


def read_records(spark: SparkSession, path: str | list[str], fmt: str | None = None, qual: str | list[str] | None = None, fields: str = "id,desc,seq", header: bool = False, split_bytes: int = SPLIT_BYTES, quoted: bool = False) -> DataFrame:
    """Records of one or several files with ``_input``, ``_path`` and ``_ord``. ``qual`` has the files of a FASTA's scores."""
    files = expand(path)
    f = resolve_input(files[0], fmt)
    if f.delimiter:
        return read_delimited(spark, files, f.delimiter, fields, header, quoted)
    df = _source(spark, f.name if f.name == "fastq" else "fasta", files, split_bytes)
    return with_scores(df, _qual_source(spark, expand(qual), split_bytes)) if qual else df


def _qual_source(spark: SparkSession, files: list[str], split_bytes: int) -> DataFrame:
    return _source(spark, "qual", files, split_bytes)


def with_scores(df: DataFrame, scores: DataFrame) -> DataFrame:
    """FASTA records with the qualities of a file of scores, record by record; ids and lengths must agree."""
    from ..operators.keyed import _zipped  # both sides by position

    z = _zipped((df, scores), check_ids=True)
    qual = quality_of_phred(F.col("_r1.seq"))
    checked = F.when(F.length(qual) == F.length("_r0.seq"), qual).otherwise(F.raise_error(F.concat(F.lit("scores of another length: "), F.col("_r0.id"))).cast("string"))
    return z.select("_r0.id", "_r0.desc", "_r0.seq", checked.alias("qual"), F.col("_num").alias("_ord"))


def column_map(fields: str, names: list[str] | None) -> dict[str, int | str]:
    """Record fields to columns: in order (id,seq), by number (id:2,seq:9) or by name (id:ID,seq:Sequence); never mixed."""
    parts = [p.partition(":") for p in fields.split(",")]
    if len({bool(sep) for _, sep, _ in parts}) != 1:
        raise ValueError(f"fields must all be in order or all be mapped: {fields!r}")
    out: dict[str, int | str] = {}
    for k, (name, sep, col) in enumerate(parts):
        out[name.strip()] = k if not sep else int(col) - 1 if col.isdigit() else col
    if len({isinstance(v, int) for v in out.values()}) != 1:
        raise ValueError(f"fields must all be numbers or all be names: {fields!r}")
    if unknown := set(out) - {"id", "desc", "seq", "qual"}:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    if missing := {"id", "seq"} - set(out):
        raise ValueError(f"missing fields: {sorted(missing)}")
    return out


def _numbered(files: list[str], header: bool):
    """(value, path, block) of lines, in the order of the files, to (value, _ord, _input, _path); blank lines and the first line of each file with a header are left out."""
    plain = lambda p: unquote(p.removeprefix("file:")).lstrip("/") if p.startswith("file:") else p.lstrip("/")
    number = {plain(p): i for i, p in enumerate(files)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = None, 0
        for b in batches:
            rows = []
            for value, path, block in zip(*(c.to_pylist() for c in b.columns)):
                if key != (path, block):
                    key, n = (path, block), 0
                # a line takes a byte at least, so places in a block never reach the next one
                if value and (n or block or not header):
                    i = number[plain(path)]
                    rows.append((value, block + n, i, files[i]))
                n += 1
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=["value", "_ord", "_input", "_path"])

    return run


def quoted_lines(f: io.BufferedIOBase) -> Iterator[tuple[int, str]]:
    """(place, text) of the records of a file with quoted fields. A line whose quotes don't pair is joined with the next ones until they do."""
    at, held, quotes = 0, [], 0
    for line in f:
        held.append(line)
        quotes += line.count(b'"')
        if quotes % 2 == 0:
            whole = b"".join(held)
            if text := whole.decode().removesuffix("\n").removesuffix("\r"):
                yield at, text
            at, held, quotes = at + len(whole), [], 0
    if held:
        raise ValueError(f"a quote isn't closed: {held[0][:60]!r}")


def read_quoted(spark: SparkSession, files: list[str], delim: str, fields: str = "id,desc,seq", header: bool = False) -> DataFrame:
    """As ``read_delimited``, with quoted fields. A file is read by one task, as only its start tells which quotes open."""
    from ..operators.rejects import cut_quoted

    mapped = column_map(fields, None)
    header = header or any(isinstance(v, str) for v in mapped.values())

    kinds = [pa.string()] * 4 + [pa.int64(), pa.int32(), pa.string()]
    names = [*FIELDS[:4], "_ord", "_input", "_path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, p in zip(*(c.to_pylist() for c in b.columns)):
                at = None if header else mapped
                with open_file(p) as f:
                    lines_ = quoted_lines(f)
                    while part := list(itertools.islice(lines_, BATCH)):
                        cells = cut_quoted([t for _, t in part], delim)
                        if at is None:
                            at = {k: cells[0].index(v) if isinstance(v, str) else v for k, v in mapped.items()}
                            part, cells = part[1:], cells[1:]
                        of = lambda k: [None] * len(cells) if k not in at else [c[at[k]] if at[k] < len(c) else "" for c in cells]  # noqa: B023, E731
                        cols = [*(of(k) for k in FIELDS[:4]), [x for x, _ in part], [i] * len(part), [p] * len(part)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    paths = spark.createDataFrame(list(enumerate(files)), "i int, p string").repartition(max(1, len(files)), "i")
    return paths.mapInArrow(run, "id string, desc string, seq string, qual string, _ord bigint, _input int, _path string")


def read_delimited(spark: SparkSession, files: list[str], delim: str, fields: str = "id,desc,seq", header: bool = False, quoted: bool = False) -> DataFrame:
    """Lines cut at the delimiter, without quoting unless ``quoted``; short lines are filled with ''. Blank lines are left out.

    All files are one scan. With a header the first line of each file is left out, whatever other lines look like it.
    """
    if quoted:
        return read_quoted(spark, files, delim, fields, header)
    mapped = column_map(fields, None)
    header = header or any(isinstance(v, str) for v in mapped.values())
    names: list[str] = []
    if header:
        with open_file(files[0]) as f:
            names = f.readline().decode().rstrip("\r\n").split(delim)
    raw = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    numbered = raw.mapInArrow(_numbered(files, header), "value string, _ord bigint, _input int, _path string")
    cols = F.split(F.regexp_replace("value", "\r$", ""), "\\Q" + delim + "\\E", -1)
    at = lambda v: names.index(v) if isinstance(v, str) else v
    pick = lambda f: F.coalesce(F.get(cols, F.lit(at(mapped[f]))), F.lit("")) if f in mapped else F.lit(None).cast("string")
    return numbered.select(*(pick(f).alias(f) for f in FIELDS[:4]), "_ord", "_input", "_path")


def as_fasta(df: DataFrame, wrap: int | None = None) -> DataFrame:
    """One text column, a record a row; a null desc leaves no blank behind the id."""
    head = F.concat(F.lit(">"), F.col("id"), F.coalesce(F.concat(F.lit(" "), F.col("desc")), F.lit("")))
    seq = F.regexp_replace("seq", f"(?s)(.{{{wrap}}})(?=.)", "$1\n") if wrap else F.col("seq")
    return df.select(F.concat(head, F.lit("\n"), seq).alias("value"))


def as_fastq(df: DataFrame, source: str = "sanger", target: str = "sanger") -> DataFrame:
    """As ``as_fasta``; a record without qualities, or with others in number than letters, is an error."""
    head = F.concat(F.lit("@"), F.col("id"), F.coalesce(F.concat(F.lit(" "), F.col("desc")), F.lit("")))
    qual = F.when(F.col("qual").isNull(), F.raise_error(F.concat(F.lit("no quality scores: "), F.col("id"))).cast("string")).otherwise(convert_quality(F.col("qual"), source, target) if source != target else check_quality(F.col("qual"), source))
    same = F.when(F.length("qual") == F.length("seq"), qual).when(F.col("qual").isNull(), qual).otherwise(F.raise_error(F.concat(F.lit("lengths of seq and qual differ: "), F.col("id"))).cast("string"))
    return df.select(F.concat(head, F.lit("\n"), F.col("seq"), F.lit("\n+\n"), same).alias("value"))


def as_scores(df: DataFrame, source: str = "sanger") -> DataFrame:
    head = F.concat(F.lit(">"), F.col("id"), F.coalesce(F.concat(F.lit(" "), F.col("desc")), F.lit("")))
    return df.select(F.concat(head, F.lit("\n"), phred_list(F.col("qual"), source)).alias("value"))


def as_delimited(df: DataFrame, delim: str, fields: str = "id,desc,seq", ctx: Context | None = None) -> DataFrame:
    """Templates parted by the delimiter, unquoted, undefined values by that word; no header line."""
    return df.select(F.concat_ws(delim, *(compile_template(ctx or Context(), f, raw=True).printed() for f in split_list(fields))).alias("value"))


def write_records(df: DataFrame, path: str, source: Format | None = None, fmt: str | None = None, fields: str = "id,desc,seq", wrap: int | None = None, qual_path: str | None = None, mode: str = "errorifexists", level: int | None = None, ctx: Context | None = None) -> Format:
    """Writes a folder of text parts in input order. Returns the format written.

    gz and bz2 are written by Spark's codecs; lz4 and zstd, and any codec with a ``level``, by this library (mode errorifexists, overwrite or append).
    """
    source = source or Format()
    f = resolve_output(path, source, fmt)
    ordered = df.orderBy("_ord") if "_ord" in df.columns else df
    text = lines(ordered, f, source, fields, wrap, ctx)
    if f.compression in ("lz4", "zstd") or (f.compression and level is not None):
        _write_parts(text.select(F.lit("part").alias("_out"), "value"), path, f.compression, level, mode, f.name)
    else:
        text.write.mode(mode).option("compression", {None: "none", "gz": "gzip", "bz2": "bzip2"}[f.compression]).text(path)
    if qual_path:
        as_scores(ordered, source.quality).write.mode(mode).text(qual_path)
    return f


def lines(df: DataFrame, f: Format, source: Format, fields: str = "id,desc,seq", wrap: int | None = None, ctx: Context | None = None) -> DataFrame:
    if f.delimiter:
        return as_delimited(df, f.delimiter, fields, ctx)
    return as_fastq(df, source.quality, f.quality) if f.name == "fastq" else as_fasta(df, wrap)


def write_dropped(kept: DataFrame, dropped: DataFrame, path: str, dropped_path: str, **options) -> None:
    """The records that an operator keeps and those it drops, each to its own place."""
    write_records(kept, path, **options)
    write_records(dropped, dropped_path, **options)


def _compress(kind: str | None, data: bytes, level: int | None) -> bytes:
    if kind == "gz":
        import gzip

        return gzip.compress(data, 6 if level is None else level)
    if kind == "bz2":
        import bz2

        return bz2.compress(data, 9 if level is None else level)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=3 if level is None else level).compress(data)
    if kind == "lz4":
        return pa.Codec("lz4", compression_level=level).compress(data, asbytes=True)
    return data


def _write_parts(rows: DataFrame, root: str, compression: str | None, level: int | None, mode: str, suffix: str = "") -> list[tuple[str, int]]:
    """Writes rows (_out, value) below ``root``, a file for each path and task; returns the rows of each path.

    Tasks write to a folder of their attempt and tell what they wrote; only what the successful attempts told is moved to
    its place, so a repeated or lost attempt leaves nothing. Concatenated parts are valid files in all formats and codecs.
    """
    fs, inner = file_system(root)
    there = fs.get_file_info(inner).type != pafs.FileType.NotFound
    if there and mode == "errorifexists":
        raise ValueError(f"{root} exists")
    if there and mode == "overwrite":
        fs.delete_dir(inner)
    mark = uuid.uuid4().hex[:12]
    temporary = f"{inner.rstrip('/')}/_temporary-{mark}"
    ending = f".{suffix}.{ {'gz': 'gz', 'bz2': 'bz2', 'zstd': 'zst', 'lz4': 'lz4'}[compression]}" if suffix and compression else f".{suffix}" if suffix else ""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, _ = file_system(root)
        part, attempt = task.partitionId(), f"{temporary}/{task.partitionId():05d}-{task.taskAttemptId()}"
        counts: dict[str, int] = {}
        open_: dict[str, pafs.FileSystem] = {}
        for b in batches:
            groups: dict[str, list[str]] = {}
            for out, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                groups.setdefault(out, []).append(value)
            for out, values in groups.items():
                # rows come sorted by path, so a path that is left doesn't come back
                for other in [o for o in open_ if o not in groups]:
                    open_.pop(other).close()
                if out not in open_:
                    stem, dot, ext = out.partition(".")
                    name = f"{attempt}/{stem}-{mark}.part{part:05d}{dot}{ext}{ending}"
                    fs.create_dir(os.path.dirname(name), recursive=True)
                    open_[out] = fs.open_output_stream(name, compression=None)
                kind = compression or COMPRESSION.get(out.rsplit(".", 1)[-1].lower())
                open_[out].write(_compress(kind, ("\n".join(values) + "\n").encode(), level))
                counts[out] = counts.get(out, 0) + len(values)
        for f in open_.values():
            f.close()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([attempt] * len(counts), pa.string())], names=["path", "n", "attempt"])

    try:
        done = rows.mapInArrow(write, "path string, n bigint, attempt string").collect()  # a row a file, as committers keep them
        for attempt in {r["attempt"] for r in done}:
            for f in fs.get_file_info(pafs.FileSelector(attempt, recursive=True)):
                if f.is_file:
                    target = f"{inner.rstrip('/')}/{f.path[f.path.index(attempt) + len(attempt) + 1 :]}"
                    fs.create_dir(os.path.dirname(target), recursive=True)
                    fs.move(f.path, target)
    finally:
        if fs.get_file_info(temporary).type != pafs.FileType.NotFound:
            fs.delete_dir(temporary)
    total: dict[str, int] = {}
    for r in done:
        total[r["path"]] = total.get(r["path"], 0) + r["n"]
    return sorted(total.items())


def write_split(df: DataFrame, root: str, source: Format | None = None, level: int | None = None, mode: str = "append", **options) -> DataFrame:
    """Each record of ``split_paths`` to the file its ``_out`` names under ``root``; returns (path, n).

    Records are range-partitioned by path and place, so a large path spreads over tasks; each task writes its part of a path
    as a file of its own. The number of paths is small against the rows, as each is at least a file.
    """
    source = source or Format()
    # all paths share the format of the records; templates give the name alone
    f = resolve_output(options.pop("like", "x"), source, options.pop("fmt", None))
    keyed = df.select("_out", "_ord", *(c for c in ("id", "desc", "seq", "qual")))
    head = F.concat(F.lit("@" if f.name == "fastq" else ">"), F.col("id"), F.coalesce(F.concat(F.lit(" "), F.col("desc")), F.lit("")))
    if f.delimiter:
        line = F.concat_ws(f.delimiter, *(F.coalesce(c, F.lit("undefined")) for c in options.get("fields", "id,desc,seq").split(",")))
    elif f.name == "fastq":
        line = F.concat(head, F.lit("\n"), F.col("seq"), F.lit("\n+\n"), convert_quality(F.col("qual"), source.quality, f.quality))
    else:
        line = F.concat(head, F.lit("\n"), F.col("seq"))
    placed = keyed.select("_out", "_ord", line.alias("_line")).repartitionByRange("_out", "_ord").sortWithinPartitions("_out", "_ord").select("_out", "_line")
    counts = _write_parts(placed.select("_out", F.col("_line").alias("value")), root, None, level, mode)
    return df.sparkSession.createDataFrame(counts, "path string, n bigint")
