import gzip

import pytest
from pyspark.sql import functions as F

from strandframe.operators import keyed
from strandframe.report import observed
from strandframe.sources import files, formats
from strandframe.streaming import records as streams


def test_fasta_splits_and_order(spark, tmp_path):
    p = tmp_path / "x.fasta"
    p.write_text("".join(f">id{i} d={i}\nAC\nGT{'A' * (i % 7)}\n" for i in range(500)))
    for size in (1 << 20, 97):
        rows = files.read_records(spark, str(p), split_bytes=size).orderBy("_input", "_ord").collect()
        assert [r["id"] for r in rows] == [f"id{i}" for i in range(500)]
        assert rows[3]["desc"] == "d=3" and rows[3]["seq"] == "ACGTAAA"


def test_fastq_splits(spark, tmp_path):
    p = tmp_path / "x.fq"
    p.write_text("".join(f"@r{i}\nACGT{'A' * (i % 5)}\n+\n@+II{'@' * (i % 5)}\n" for i in range(300)))
    for size in (1 << 20, 83):
        rows = files.read_records(spark, str(p), split_bytes=size).orderBy("_ord").collect()
        assert [r["id"] for r in rows] == [f"r{i}" for i in range(300)]
        assert rows[2]["qual"] == "@+II@@"


def test_compressed_and_scores(spark, tmp_path):
    with gzip.open(tmp_path / "a.fa.gz", "wt") as f:
        f.write(">id\nAT\nGC\n")
    (tmp_path / "a.qual").write_text(">id\n40 40\n40 30\n")
    df = files.read_records(spark, str(tmp_path / "a.fa.gz"), qual=str(tmp_path / "a.qual"))
    assert df.first()["qual"] == "III?"
    (tmp_path / "a.qual").write_text(">id\n40  40 40\n")
    with pytest.raises(Exception, match="invalid quality scores|another length"):
        files.read_records(spark, str(tmp_path / "a.fa.gz"), qual=str(tmp_path / "a.qual")).collect()


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ID,x,Sequence\n1,"a,AC\n2\n\n')
    rows = files.read_records(spark, str(tmp_path / "a.csv"), fields="id:ID,seq:Sequence").collect()
    assert [(r["id"], r["seq"]) for r in rows] == [("1", "AC"), ("2", "")]
    with pytest.raises(ValueError):
        files.column_map("id:1,seq", None)


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "d", "ACGT", "IIII", 0), ("b", None, "A", "I", 1)], "id string, desc string, seq string, qual string, _ord bigint")
    for name in ("o.fq", "o.fasta.gz", "o.tsv"):
        files.write_records(df, str(tmp_path / name))
        back = files.read_records(spark, str(tmp_path / name), fmt=name.split(".")[1]).orderBy("_input", "_ord").collect()
        assert [(r["id"], r["seq"]) for r in back] == [("a", "ACGT"), ("b", "A")]
    n = files.write_split(keyed.split_paths(df, "{id}.fa"), str(tmp_path / "split")).collect()
    assert sorted(tuple(r) for r in n) == [("a.fa", 1), ("b.fa", 1)]
    counted, o = observed(df)
    counted.collect()
    assert o.get == {"n_records": 2}


def test_formats():
    assert formats.resolve_input("x.FQ.gz").name == "fastq" and formats.resolve_input("x.FQ.gz").compression == "gz"
    assert formats.resolve_input("x", "fq-illumina").quality == "illumina"
    assert formats.resolve_input("x").name == "fasta"
    assert formats.resolve_output("o", formats.Format("tsv")).name == "tsv"
    with pytest.raises(ValueError):
        formats.of_name("bam")


def test_streams(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("1\td\tAC\n2\td\tAC\n3\te\tG\n")
    src = streams.stream_delimited(spark, str(tmp_path))
    out = streams.run_available(streams.count_stream(src, "seqlen"), "counts", "complete", str(tmp_path / "_c1"))
    assert sorted(tuple(r) for r in out.collect()) == [("1", 1), ("2", 2)]
    once = streams.run_available(streams.unique_stream(src, "seq").select("seq"), "once", "append", str(tmp_path / "_c2"))
    assert sorted(r[0] for r in once.collect()) == ["AC", "G"]
    assert F is not None


def test_streamed_rows_are_in_files(spark, tmp_path):
    texts = ["AC", "", "é🧬", "undefined", "A" * 5000, "A" * 4999 + "C"]
    (tmp_path / "in").mkdir()
    for f in range(2):
        (tmp_path / "in" / f"{f}.tsv").write_text("".join(f"{i}\td\t{t}\n" for i, t in enumerate(texts * 3)))
    src = streams.stream_delimited(spark, str(tmp_path / "in"), max_files=1)
    provider = spark.conf.get(streams.PROVIDER, None)
    out = streams.run_available(streams.unique_stream(src, "seq").select("seq"), "in_files", "append", str(tmp_path / "state"))
    # the driver holds no rows, and later batches find the keys of earlier ones
    assert out.inputFiles() and sorted(r[0] for r in out.collect()) == sorted(texts)
    assert spark.table("in_files").count() == len(texts) and spark.conf.get(streams.PROVIDER, None) == provider
    # a state folder isn't needed, and no input is no rows
    (tmp_path / "none").mkdir()
    empty = streams.run_available(streams.unique_stream(streams.stream_delimited(spark, str(tmp_path / "none")), "id,seq"), "no_rows")
    assert empty.count() == 0 and empty.columns == ["id", "desc", "seq", "qual", "loaded_at"]


def test_lines_like_the_header_are_data(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.tsv").write_text("id\tseq\n1\tAC\nid\tseq\n\n2\tGG\r\n")
    rows = files.read_records(spark, str(tmp_path), "tsv", fields="id:id,seq:seq").orderBy("_input", "_ord").collect()
    assert [(r["_input"], r["id"], r["seq"]) for r in rows] == [(k, i, s) for k in (0, 1) for i, s in (("1", "AC"), ("id", "seq"), ("2", "GG"))]


def test_quoted_files(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,text,seq\n1,"a, ""b""\nc",AC\n"2",,"G\r\nG"\n3\n')
    rows = files.read_records(spark, str(tmp_path / "q.csv"), fields="id:id,desc:text,seq:seq", quoted=True).orderBy("_ord").collect()
    assert [(r["id"], r["desc"], r["seq"]) for r in rows] == [("1", 'a, "b"\nc', "AC"), ("2", "", "G\r\nG"), ("3", "", "")]
    (tmp_path / "w.csv").write_text('1,a"b,"AC"\n2,"x,y\n')
    with pytest.raises(Exception, match="quotes|closed"):
        files.read_records(spark, str(tmp_path / "w.csv"), quoted=True).collect()


@pytest.mark.parametrize(("ext", "level"), [("gz", 1), ("gz", None), ("bz2", 3), ("zst", None), ("zst", 12), ("lz4", None), ("lz4", 9)])
def test_codecs_and_levels(spark, tmp_path, ext, level):
    df = spark.createDataFrame([(str(i), None, "ACGT" * (i % 5), None, i) for i in range(200)], "id string, desc string, seq string, qual string, _ord bigint").repartition(3)
    path = str(tmp_path / f"o.fasta.{ext}")
    files.write_records(df, path, level=level)
    with pytest.raises(Exception, match="exist"):
        files.write_records(df, path, level=level)
    assert [r["seq"] for r in files.read_records(spark, path, "fasta").orderBy(F.col("id").cast("int")).collect()] == ["ACGT" * (i % 5) for i in range(200)]
    files.write_records(df.limit(1), path, level=level, mode="overwrite")
    assert files.read_records(spark, path, "fasta").count() == 1
    assert not [p for p in tmp_path.rglob("*") if "_temporary" in p.name]


def test_failed_writes_leave_nothing(spark, tmp_path):
    df = spark.range(100).select(F.lit("x.fa").alias("_out"), F.when(F.col("id") == 99, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="broken"):
        files._write_parts(df.repartition(4), str(tmp_path / "out"), None, None, "append")
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
