"""Queries of single variables, options, sources and sinks, each with its SQL where SQL can say it.

Queries of sources and sinks write the records of a whole table to the shared folder, read them back and give what was read.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.attrs import AttrFormat
from ..lang import script
from ..lang.variables import Context
from ..model import records, union_inputs
from ..operators import align, basic, keyed, search
from ..report import observed
from ..session import drop_path, shared_dir, table
from ..sources import files
from ..streaming import records as streams
from .record_queries import ANY_COMPLEMENT, A, D, PATTERN, R, STARTS, TILE, UP, LOW, amplicons, documents, query, reads


def folder(s: SparkSession, name: str) -> str:
    """A new place in the shared folder, dropped when the process ends."""
    own = f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"
    atexit.register(drop_path, s, own)
    return f"{own.removeprefix('file://')}/{name}"


def scored(s: SparkSession, d: str) -> DataFrame:
    """All amplicons, each with a quality for every letter."""
    return amplicons(s, d).withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))


# records without a desc and with an empty one differ in a file as in the table
ROUND = f"WITH {A} SELECT id, \"desc\", seq FROM a"


@query(ROUND)
def io_fasta(s, d):
    path = folder(s, "fasta") + ".fasta"
    files.write_records(amplicons(s, d), path, wrap=60)
    return files.read_records(s, path, "fasta").select("id", "desc", "seq")


@query(f"WITH {A} SELECT id, \"desc\", seq, repeat('I', length(seq)) AS qual FROM a")
def io_fastq(s, d):
    path = folder(s, "fastq") + ".fastq"
    files.write_records(scored(s, d), path)
    return files.read_records(s, path, "fastq").select("id", "desc", "seq", "qual")


@query(f"WITH {A} SELECT id, seq, repeat('I', length(seq)) AS qual FROM a")
def io_scores(s, d):
    path = folder(s, "scores")
    files.write_records(scored(s, d), f"{path}.fasta", qual_path=f"{path}.qual")
    return files.read_records(s, f"{path}.fasta", "fasta", qual=f"{path}.qual").select("id", "seq", "qual")


@query(f"WITH {A} SELECT id, coalesce(\"desc\", '') AS \"desc\", seq FROM a")
def io_tsv(s, d):
    path = folder(s, "tsv") + ".tsv"
    files.write_records(amplicons(s, d).withColumn("desc", F.coalesce("desc", F.lit(""))), path, fields="id,desc,seq")
    return files.read_records(s, path, "tsv").select("id", "desc", "seq")


def _compressed(s: SparkSession, d: str, ext: str, level: int | None = None) -> DataFrame:
    path = folder(s, ext) + f".fasta.{ext}"
    files.write_records(amplicons(s, d), path, level=level)
    return files.read_records(s, path, "fasta").select("id", "desc", "seq")


@query(ROUND)
def io_gzip(s, d):
    return _compressed(s, d, "gz", 1)


@query(ROUND)
def io_bzip2(s, d):
    return _compressed(s, d, "bz2")


@query(ROUND)
def io_zstd(s, d):
    return _compressed(s, d, "zst")


@query(ROUND)
def io_lz4(s, d):
    return _compressed(s, d, "lz4")


@query(f"WITH {A} SELECT id, CASE WHEN length(seq) >= 300 THEN 'kept' ELSE 'dropped' END AS sink FROM a")
def io_dropped(s, d):
    a, path = amplicons(s, d), folder(s, "dropped")
    files.write_dropped(basic.filter_records(a, "seqlen >= 300"), basic.filter_dropped(a, "seqlen >= 300"), f"{path}.kept.fasta", f"{path}.dropped.fasta")
    return files.read_records(s, [f"{path}.kept.fasta", f"{path}.dropped.fasta"], "fasta").select("id", F.when(F.col("_path").contains(".kept."), "kept").otherwise("dropped").alias("sink"))


@query(f"WITH {A} SELECT id FROM a UNION ALL SELECT id FROM a")
def io_append(s, d):
    path = folder(s, "append") + ".fasta.zst"
    for mode in ("errorifexists", "append"):
        files.write_records(amplicons(s, d), path, mode=mode)
    return files.read_records(s, path, "fasta").select("id")


@query("SELECT CAST(amp_no AS VARCHAR) AS id, coalesce(seq, '') AS seq, coalesce(run_id, 'none') AS run FROM amplicons")
def io_split(s, d):
    """Demultiplexing by an attribute: each record in the file of its run."""
    path = folder(s, "split")
    a = records(table(s, d, "amplicons").withColumn("run", F.concat(F.lit("run="), F.coalesce("run_id", F.lit("none")))), "amp_no", "seq", "run", None, "amp_no")
    files.write_split(keyed.split_paths(a, "{attr(run)}.fasta"), path)
    return files.read_records(s, path, "fasta").select("id", "seq", F.regexp_extract("_path", r"/([^/]+)-[0-9a-f]{12}\.part[0-9]+\.fasta$", 1).alias("run"))


@query("SELECT CAST(set_no AS VARCHAR) AS id, remark AS \"desc\", scores AS seq FROM score_sets WHERE remark IS NOT NULL AND scores IS NOT NULL")
def io_quoted(s, d):
    """Delimited files whose fields hold delimiters, quotes and line feeds."""
    path = folder(s, "quoted") + ".csv"
    t = table(s, d, "score_sets").where("remark IS NOT NULL AND scores IS NOT NULL")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    t.select(F.concat_ws(",", F.col("set_no").cast("string"), quoted("remark"), quoted("scores")).alias("value")).write.text(path)
    return files.read_records(s, path, "csv", quoted=True).select("id", "desc", "seq")


@query("SELECT CAST(rec_no AS VARCHAR) AS id FROM csv_records UNION ALL SELECT CAST(amp_no AS VARCHAR) FROM amplicons")
def io_header(s, d):
    """Two files with a header each; lines that look like the header are data."""
    path = folder(s, "header")
    for name, t in (("a", table(s, d, "csv_records").select(F.col("rec_no").cast("string").alias("id"))), ("b", table(s, d, "amplicons").select(F.col("amp_no").cast("string").alias("id")))):
        t.withColumn("seq", F.lit("A")).write.option("header", "true").option("sep", "\t").csv(f"{path}/{name}.tsv")
    return files.read_records(s, path, "tsv", fields="id:id,seq:seq").select("id")


@query(f"WITH {R} SELECT id FROM r ORDER BY ord OFFSET 99")
def slice_open(s, d):
    return basic.slice_records(reads(s, d), 100, None).select("id")


@query(f"WITH {R} SELECT id, CAST(NULL AS VARCHAR) AS \"desc\", seq FROM r")
def del_desc(s, d):
    return basic.delete(reads(s, d), desc=True).select("id", "desc", "seq")


@query(f"WITH {A} SELECT id, {ANY_COMPLEMENT} AS seq FROM a")
def revcomp_auto(s, d):
    return basic.revcomp(amplicons(s, d)).select("id", "seq")


@query(f"WITH {A} SELECT id, {ANY_COMPLEMENT} AS seq FROM a")
def revcomp_strict(s, d):
    return basic.revcomp(amplicons(s, d), strict=True).select("id", "seq")


DEFAULT_KEY = f"WITH {R}, {A}, j AS (SELECT coalesce(r.id, a.id) AS id, CASE WHEN a.ord IS NULL THEN 'unique1' WHEN r.ord IS NULL THEN 'unique2' ELSE 'common' END AS category FROM r FULL JOIN a ON r.id = a.id AND r.seq = a.seq)"


@query(DEFAULT_KEY + " SELECT id, category FROM j")
def cmp_default(s, d):
    return keyed.compare(reads(s, d), amplicons(s, d)).select(F.coalesce("id1", "id2").alias("id"), "category")


@query(f"WITH {R}, {A} SELECT coalesce(r.id, a.id) AS key, r.id AS id1, a.id AS id2 FROM r FULL JOIN a ON r.id = a.id")
def cmp_key(s, d):
    return keyed.compare(reads(s, d), amplicons(s, d), "id").select("key", "id1", "id2")


@query(f"WITH {R}, {A} SELECT r.id, r.seq AS first, a.seq AS second, true AS even, true AS filled FROM r JOIN a ON r.id = a.id")
def cmp_diff(s, d):
    """Both records of each common id aligned with each other: without gaps the texts are as they were, and no place has two gaps."""
    common = keyed.compare(reads(s, d), amplicons(s, d), "id").where("category = 'common'")
    x = common.select(F.col("id1").alias("id"), "seq1", "seq2").withColumn("x", align.aligned(F.translate("seq1", "-", "~"), F.translate("seq2", "-", "~")))
    back = lambda c: F.translate(F.replace(F.col(f"x.{c}"), F.lit("-"), F.lit("")), "~", "-")
    both = F.exists(F.arrays_zip(F.split("x.a", ""), F.split("x.b", "")), lambda p: (p["0"] == "-") & (p["1"] == "-"))
    return x.select("id", back("a").alias("first"), back("b").alias("second"), (F.length("x.a") == F.length("x.b")).alias("even"), (~both).alias("filled"))


@query(f"WITH {R}, {A}, u AS (SELECT id, ord, 1 AS k FROM r UNION ALL SELECT id, ord, 2 FROM a) SELECT id, k, row_number() OVER (ORDER BY k, ord) AS num, row_number() OVER (PARTITION BY k ORDER BY ord) AS own FROM u")
def union_numbers(s, d):
    u = basic.number_records(union_inputs(reads(s, d), amplicons(s, d)))
    return basic.stat(u.withColumn("id", F.concat_ws("/", "id", F.col("_input") + 1)), ["seq_num", "seq_num(true)"], names=["num", "own"]).select(F.substring_index("id", "/", 1).alias("id"), F.substring_index("id", "/", -1).cast("int").alias("k"), "num", "own")


@query("SELECT true AS same, false AS other")
def equal_check(s, d):
    a = amplicons(s, d)
    return s.createDataFrame([(keyed.is_equal(a, a), keyed.is_equal(a, reads(s, d)))], "same boolean, other boolean")


@query(f"WITH {A} SELECT count(*) AS n, sum(length(seq)) AS letters FROM a")
def run_report(s, d):
    a, o = observed(amplicons(s, d), "n", letters=F.length("seq"))
    a.write.format("noop").mode("overwrite").save()
    return s.createDataFrame([(o.get["n"], o.get["letters"])], "n bigint, letters bigint")


@query(f"WITH {D} SELECT id, translate(seq, '{UP}', '{LOW}') AS seq FROM d")
def var_lower_seq(s, d):
    return basic.stat(documents(s, d), ["lower_seq"], names=["seq"])


@query(f"WITH {R} SELECT min_by(id, ord) AS id, count(*) AS n FROM r GROUP BY seq")
def var_seqhash(s, d):
    return keyed.unique(reads(s, d), "seqhash").select("id", F.col("n_duplicates").alias("n"))


@query(f"WITH {R} SELECT min_by(id, ord) AS id, count(*) AS n FROM r GROUP BY translate(seq, '{LOW}', '{UP}')")
def var_seqhash_case(s, d):
    return keyed.unique(reads(s, d), "seqhash(true)").select("id", F.col("n_duplicates").alias("n"))


@query(f"WITH {A} SELECT min_by(id, ord) AS id, count(*) AS n FROM (SELECT id, ord, {ANY_COMPLEMENT} AS s FROM a) GROUP BY s")
def var_seqhash_rev(s, d):
    return keyed.unique(amplicons(s, d), "seqhash_rev").select("id", F.col("n_duplicates").alias("n"))


@query("SELECT CAST(amp_no AS VARCHAR) AS id, '/data/' || coalesce(run_id, 'x') || '/pool.' || (amp_no % 3) || '.fa.gz' AS path, 'pool.' || (amp_no % 3) || '.fa.gz' AS filename, 'pool.' || (amp_no % 3) AS filestem, 'fa' AS extension, '/data/' || coalesce(run_id, 'x') AS dirname, 'fastq' AS default_ext FROM amplicons")
def var_path(s, d):
    t = table(s, d, "amplicons")
    a = records(t, "amp_no", "seq", "run_id", None, "amp_no").withColumn("_path", F.concat(F.lit("/data/"), F.coalesce("desc", F.lit("x")), F.lit("/pool."), (F.col("_ord") % 3).cast("string"), F.lit(".fa.gz")))
    return basic.stat(a, "path,filename,filestem,extension,dirname,default_ext", Context(default_ext="fastq"))


@query(f"WITH {A} SELECT id, CASE WHEN t > 0 THEN round(100 * g / t, 7) ELSE 'NaN'::DOUBLE END AS gc FROM (SELECT id, CAST(length(seq) - length(translate(seq, 'GC', '')) AS DOUBLE) AS g, length(seq) - length(translate(seq, 'ACGTU', '')) AS t FROM a)")
def var_gc_percent(s, d):
    return basic.stat(amplicons(s, d), ["gc_percent"], names=["gc"]).withColumn("gc", F.round("gc", 7))


@query(f"WITH {R} SELECT id, coalesce({TILE} IS NOT NULL, false) AS has_tile FROM r")
def var_has_attr(s, d):
    return basic.stat(reads(s, d), ["has_attr(tile)"], names=["has_tile"])


SIZE = "CASE WHEN \"desc\" LIKE '%size=%' THEN regexp_extract(\"desc\", 'size=(\\d+)', 1) END"


def sized(s: SparkSession, d: str) -> tuple[DataFrame, Context]:
    return amplicons(s, d).withColumn("desc", F.concat(F.lit(";"), F.col("desc"))), Context(attr_format=AttrFormat.parse(";key=value"))


@query(f"WITH {A} SELECT id, {SIZE} AS size FROM a")
def attr_format(s, d):
    a, ctx = sized(s, d)
    return basic.stat(a, ["opt_attr(size)"], ctx, ["size"])


@query(f"WITH {R} SELECT id, coalesce({TILE}, 'undefined') || ':' || length(seq) AS id2, CASE WHEN regexp_matches(\"desc\", '^tile=') THEN regexp_replace(\"desc\", '^tile=[^ ]* ?', '') ELSE regexp_replace(\"desc\", ' tile=[^ ]*', '') END AS \"desc\" FROM r")
def attr_taken_opt(s, d):
    """opt_attr_del gives the value and takes the attribute out of the header."""
    r = reads(s, d).withColumn("ref", F.col("id"))
    x = basic.set_fields(r, id="{opt_attr_del(tile)}:{seqlen}")
    return x.select(F.col("ref").alias("id"), F.col("id").alias("id2"), "desc")


@query(f"WITH {A} SELECT id, {SIZE} AS size, 'kept=1' || coalesce(' ' || \"desc\", '') AS \"desc\" FROM a WHERE {SIZE} IS NOT NULL")
def attr_taken(s, d):
    """attr_del of an attribute that all records have."""
    a = amplicons(s, d).where(F.col("desc").contains("size="))
    a = a.withColumn("desc", F.concat(F.lit("kept=1 n="), F.regexp_extract("desc", r"size=(\d+)", 1), F.lit(" "), F.col("desc")))
    x = basic.set_fields(a, id="{id}/{attr_del(n)}")
    return x.select(F.substring_index("id", "/", 1).alias("id"), F.substring_index("id", "/", -1).alias("size"), "desc")


@query("SELECT r.run_id AS id, arg_min(c.id, c.rec_no) AS first_id FROM seq_runs r LEFT JOIN (SELECT * FROM csv_records) c ON c.run_id = r.run_id GROUP BY 1")
def meta_first(s, d):
    """Of several rows of an id the first one counts."""
    side = table(s, d, "csv_records").select("run_id", F.col("id").alias("first_id"), F.col("rec_no").alias("_ord"))
    df, ctx = keyed.with_meta(records(table(s, d, "seq_runs"), "run_id", "instrument"), side, id_col="run_id")
    return basic.stat(df, ["opt_meta(first_id)"], ctx, ["first_id"])


@query("SELECT run_id AS id, qual_fmt, qual_fmt AS second, true AS known FROM seq_runs")
def meta_values(s, d):
    runs = table(s, d, "seq_runs")
    df, ctx = keyed.with_meta(records(runs, "run_id", "instrument"), runs.select("run_id", "flowcell"), runs)
    return basic.stat(df, ["meta(qual_fmt, 2)", "{meta('qual_fmt', 2)}", "has_meta(2)"], ctx, ["qual_fmt", "second", "known"])


@query(f"WITH {R} SELECT id, CAST(length(seq) AS VARCHAR) || ',' || coalesce(\"desc\", '') AS key FROM (SELECT *, row_number() OVER (PARTITION BY length(seq), coalesce(\"desc\", '') ORDER BY ord) AS k FROM r) WHERE k = 1")
def unique_key(s, d):
    u = keyed.unique(reads(s, d), "seqlen,desc")
    return basic.stat(u, ["key"], keyed.unique_context())


@query(f"WITH {A} SELECT id, CAST(length(seq) AS VARCHAR) || ',' || id AS key, row_number() OVER (ORDER BY length(seq), id) AS rank FROM a")
def sort_key(s, d):
    a, ctx = basic.with_key(amplicons(s, d), "seqlen,id")
    x = basic.sort_ranks(a, "seqlen,id", ctx=ctx)
    return basic.stat(x.withColumn("id", F.concat_ws("|", "id", "_rank")), ["key"], ctx).select(F.substring_index("id", "|", 1).alias("id"), "key", F.substring_index("id", "|", -1).cast("bigint").alias("rank"))


P, N = PATTERN, len(PATTERN)


@query(
    f"WITH {A}, m AS (SELECT id, length(seq) AS n, {STARTS} AS s FROM a WHERE contains(seq, '{P}')) SELECT id, '{P}' AS match, '{P}' AS aligned_match, '{P}' AS aligned_pattern, s + {N - 1} AS match_end, s + {N - 2} - n AS match_neg_end, "
    f"(s - 1 - n) || ':' || (s + {N - 2} - n) AS match_neg_range, 0 AS match_diffs, 0 AS match_ins, 0 AS match_del, 0 AS match_subst, 0.0::DOUBLE AS match_diff_rate, 'motif' AS pattern_name, '{P}' AS pattern, {N} AS pattern_len, {N} AS match_len FROM m"
)
def find_vars(s, d):
    se = search.Search(search.pattern_of(P, "motif"))
    names = "match,aligned_match,aligned_pattern,match_end,match_neg_end,match_neg_range,match_diffs,match_ins,match_del,match_subst,match_diff_rate,pattern_name,pattern,pattern_len,match_len".split(",")
    return basic.stat(search.matched(search.find(amplicons(s, d), se)), names, search.find_context(se))


@query(
    rf"WITH {D}, m AS (SELECT id, seq, length(seq) AS n, regexp_extract(seq, 'seqtable@(\d+)\.(\d+)', 0) AS m, regexp_extract(seq, 'seqtable@(\d+)\.(\d+)', 1) AS g FROM d WHERE regexp_matches(seq, 'seqtable@(\d+)\.(\d+)')), p AS (SELECT *, strpos(seq, m) + 9 AS s FROM m)"
    " SELECT id, g, s, s + length(g) - 1 AS e, s - 1 - n AS neg_s, s + length(g) - 2 - n AS neg_e, s || ':' || (s + length(g) - 1) AS r FROM p"
)
def find_groups(s, d):
    se = search.Search(search.pattern_of(r"seqtable@(?<major>\d+)\.(\d+)"), regex=True)
    f = search.matched(search.find(documents(s, d), se))
    return basic.stat(f, "match_group(major),match_grp_start(1),match_grp_end(major),match_grp_neg_start(1),match_grp_neg_end(1),match_grp_range(1)", search.find_context(se), ["g", "s", "e", "neg_s", "neg_e", "r"])


@query(f"WITH {R} SELECT id FROM r WHERE contains(\"desc\", 'tile')")
def find_desc(s, d):
    se = search.Search(search.pattern_of("tile"))
    return search.matched(search.find(reads(s, d), se, field="desc")).select("id")


@query(f"WITH {R} SELECT id FROM r WHERE regexp_matches(id, '^1.*7$')")
def find_id(s, d):
    return reads(s, d).where(search.has_match(search.Search(search.pattern_of("^1.*7$"), regex=True), "id")).select("id")


@query(f"WITH {A} SELECT id, strpos(seq, 'GGA') AS s FROM a WHERE strpos(seq, 'GGA') BETWEEN 1 AND 6")
def find_anchor_start(s, d):
    se = search.Search(search.pattern_of("GGA"), anchor_start=5)
    f = search.matched(search.find(amplicons(s, d), se))
    return basic.stat(f, ["match_start"], search.find_context(se), ["s"])


@query(f"WITH {A} SELECT id FROM a WHERE right(seq, 3) = 'TTG'")
def find_anchor_end(s, d):
    se = search.Search(search.pattern_of("TTG"), anchor_end=0)
    return search.matched(search.find(amplicons(s, d), se)).select("id")


@query(f"WITH {A} SELECT id, strpos(substr(seq, 51, 100), 'CCA') + 50 AS s FROM a WHERE contains(substr(seq, 51, 100), 'CCA')")
def find_in_range(s, d):
    from ..lang.ranges import Range

    se = search.Search(search.pattern_of("CCA"))
    f = search.matched(search.find(amplicons(s, d), se, rng=Range(51, 150)))
    return basic.stat(f, ["match_start"], search.find_context(se), ["s"])


NEAR = "GATTACAG"
ONE_EDIT = "|".join(sorted({NEAR[:i] + x + NEAR[i + 1 :] for i in range(8) for x in ("", ".")} | {NEAR[:i] + "." + NEAR[i:] for i in range(1, 8)}))


@query(f"WITH {A} SELECT id, CASE WHEN contains(seq, '{NEAR}') THEN 0 ELSE 1 END AS diffs FROM a WHERE regexp_matches(seq, '{ONE_EDIT}')")
def find_one_edit(s, d):
    """Approximate search: all records with a place within one difference, and the least differences."""
    se = search.Search(search.pattern_of(NEAR), max_diffs=1)
    f = search.matched(search.find(amplicons(s, d), se, hits="best"))
    return basic.stat(f, ["match_diffs"], search.find_context(se), ["diffs"])


PRIMER = "GTCTCGAGTTTGACTAATTG"


@query(
    f"WITH {A}, e AS (SELECT id, min(levenshtein('{PRIMER}', substr(seq, s, n))) AS diffs FROM a, range(1, 6) AS x(s), range(16, 25) AS y(n) WHERE s + n - 1 <= length(seq) GROUP BY 1) SELECT id, diffs FROM e WHERE diffs <= 4"
)
def find_approx_diffs(s, d):
    """The primer of find_approx: all records that begin with it within four letters, and its least differences."""
    se = search.Search(search.pattern_of(PRIMER, "fwd"), max_diffs=4, anchor_start=4)
    f = search.matched(search.find(amplicons(s, d), se))
    return basic.stat(f, ["match_diffs"], search.find_context(se), ["diffs"])


@query(f"WITH {A} SELECT id FROM a WHERE regexp_matches(seq, '{ONE_EDIT}')")
def find_rate(s, d):
    se = search.Search(search.pattern_of(NEAR), max_rate=0.2)
    return search.matched(search.find(amplicons(s, d), se)).select("id")


@query(f"WITH {A} SELECT id, CASE WHEN contains(seq, 'GATTACA') THEN 'p1' WHEN contains(seq, 'CCCGGG') THEN 'p2' ELSE 'p3' END AS pattern_name FROM a WHERE contains(seq, 'GATTACA') OR contains(seq, 'CCCGGG') OR contains(seq, 'TTTAAAT')")
def find_pattern_file(s, d):
    path = folder(s, "patterns") + ".fasta"
    files.write_records(s.createDataFrame([("p1", None, "GATTACA", None, 0), ("p2", None, "CCCGGG", None, 1), ("p3", None, "TTTAAAT", None, 2)], "id string, desc string, seq string, qual string, _ord bigint"), path)
    se = search.Search(search.read_patterns(s, f"file:{path}"))
    return basic.stat(search.matched(search.find(amplicons(s, d), se)), "pattern_name", search.find_context(se))


@query(f"WITH {R} SELECT id, substr(seq, 4, 7) AS seq FROM r")
def trim_zero_based(s, d):
    return basic.trim(reads(s, d), "3:10", zero_based=True).select("id", "seq")


@query(f"WITH {R} SELECT id, substr(seq, 4, 6) AS seq FROM r")
def trim_exclusive(s, d):
    return basic.trim(reads(s, d), "3:10", exclusive=True).select("id", "seq")


@query(f"WITH {A} SELECT id, substr(seq, 1, CASE WHEN {SIZE} IS NULL THEN length(seq) ELSE CAST({SIZE} AS INT) END) AS seq FROM a")
def trim_template(s, d):
    a, ctx = sized(s, d)
    return basic.trim(a, ":{opt_attr(size)}", ctx=ctx).select("id", "seq")


@query(f"WITH {R} SELECT id, CASE WHEN length(seq) >= 60 THEN 'long-' || length(seq) ELSE 'short' END AS kind FROM r")
def js_script(s, d):
    """Functions and constants of a script."""
    ctx = script.define(Context(), "const limit = 60; // letters\nfunction label(n, word) { if (n >= limit) return word + '-' + n; return 'short'; }".replace("; // letters", ";"))
    return basic.stat(reads(s, d), ["{label(seqlen, 'long')}"], ctx, ["kind"])


@query("SELECT CAST(length(coalesce(seq, '')) AS VARCHAR) AS key, count(*) AS n FROM amplicons GROUP BY 1")
def stream_count(s, d):
    path = folder(s, "stream")
    amplicons(s, d).select(F.concat_ws("\t", "id", F.lit("x"), "seq").alias("value")).write.text(path)
    return streams.run_available(streams.count_stream(streams.stream_delimited(s, path), "seqlen"), f"t{uuid.uuid4().hex}", "complete", folder(s, "state"))


@query("SELECT DISTINCT coalesce(seq, '') AS seq FROM amplicons")
def stream_unique(s, d):
    path, state = folder(s, "stream"), folder(s, "state")
    amplicons(s, d).select(F.concat_ws("\t", "id", F.lit("x"), "seq").alias("value")).write.option("compression", "gzip").text(path)
    out = streams.run_available(streams.unique_stream(streams.stream_delimited(s, path), "seq").select("seq"), f"t{uuid.uuid4().hex}", "append", state)
    for p in (path, state):
        drop_path(s, p)
    return out


@query("SELECT CAST(amp_no AS VARCHAR) AS id, translate(coalesce(seq, ''), '" + LOW + "', '" + UP + "') AS seq FROM amplicons WHERE length(coalesce(seq, '')) >= 300")
def stream_stateless(s, d):
    path = folder(s, "stream")
    amplicons(s, d).select(F.concat_ws("\t", "id", F.lit("x"), "seq").alias("value")).write.text(path)
    x = basic.upper(basic.filter_records(streams.stream_delimited(s, path), "seqlen >= 300"))
    return streams.run_available(x.select("id", "seq"), f"t{uuid.uuid4().hex}", "append", folder(s, "state"))
