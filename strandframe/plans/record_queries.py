"""Queries of the record operators over the driver's tables, each with its SQL where SQL can say it.

Records: csv_records (id rec_no, desc descr), amplicons (id amp_no), documents (id doc_id). The
order of input is the id, as parquet rows have no promised order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, sequence
from ..functions.attrs import AttrFormat
from ..lang.template import compile_template
from ..lang.variables import Context
from ..model import records
from ..operators import basic, keyed, search
from ..session import table

QUERIES: dict = {}
SQL: dict = {}

R = "r AS (SELECT CAST(rec_no AS VARCHAR) AS id, descr AS \"desc\", coalesce(seq, '') AS seq, qual, rec_no AS ord FROM csv_records)"
A = "a AS (SELECT CAST(amp_no AS VARCHAR) AS id, descr AS \"desc\", coalesce(seq, '') AS seq, amp_no AS ord FROM amplicons)"
D = "d AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang AS \"desc\", coalesce(text, '') AS seq, doc_id AS ord FROM documents)"
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COMPLEMENT = f"reverse(translate(seq, '{sequence.DNA}', '{sequence.DNA_COMPLEMENT}'))"
#: The complement of any sequence: RNA where there is a U and no T.
ANY_COMPLEMENT = f"CASE WHEN regexp_matches(seq, '[Uu]') AND NOT regexp_matches(seq, '[Tt]') THEN reverse(translate(seq, '{sequence.RNA}', '{sequence.RNA_COMPLEMENT}')) ELSE {COMPLEMENT} END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def reads(s: SparkSession, d: str) -> DataFrame:
    return records(table(s, d, "csv_records"), "rec_no", "seq", "descr", "qual", "rec_no")


def amplicons(s: SparkSession, d: str) -> DataFrame:
    return records(table(s, d, "amplicons"), "amp_no", "seq", "descr", None, "amp_no")


def documents(s: SparkSession, d: str) -> DataFrame:
    return records(table(s, d, "documents"), "doc_id", "text", "lang", None, "doc_id")


@query("SELECT count(*) AS n FROM documents")
def count_all(s, d):
    return basic.count(documents(s, d))


@query(f"WITH {R} SELECT CAST(length(seq) AS VARCHAR) AS key, count(*) AS n FROM r GROUP BY 1")
def count_key(s, d):
    return basic.count_by(reads(s, d), "seqlen")


@query(f"WITH {R} SELECT CAST(length(seq) AS VARCHAR) AS key1, CAST(length(replace(seq, '-', '')) AS VARCHAR) AS key2, count(*) AS n FROM r GROUP BY 1, 2")
def count_multi(s, d):
    return basic.count_by(reads(s, d), "seqlen,ungapped_seqlen")


@query(f"WITH {D} SELECT '(' || CAST(length(seq) // 1000 * 1000 AS VARCHAR) || ', ' || CAST(length(seq) // 1000 * 1000 + 1000 AS VARCHAR) || ']' AS key, count(*) AS n FROM d GROUP BY 1")
def count_bin(s, d):
    return basic.count_by(documents(s, d), "bin(seqlen,1000)")


@query(f"WITH {A} SELECT CASE WHEN t = 0 THEN '(NaN, NaN]' ELSE '(' || CAST(CAST(floor(100.0 * g / t / 10) * 10 AS BIGINT) AS VARCHAR) || ', ' || CAST(CAST(floor(100.0 * g / t / 10) * 10 + 10 AS BIGINT) AS VARCHAR) || ']' END AS key, count(*) AS n FROM (SELECT length(seq) - length(translate(seq, 'GC', '')) AS g, length(seq) - length(translate(seq, 'ACGTU', '')) AS t FROM a) GROUP BY 1")
def count_gc_bin(s, d):
    g = amplicons(s, d)
    ctx = Context()
    # whole percents of counts are exact, so both engines put the same records at a bin's edge
    return basic.count_by(g, "{bin(charcount('GC') * 100 / charcount('ACGTU'), 10)}", ctx)


@query(f"WITH {R} SELECT id, length(seq) AS seqlen, length(replace(seq, '-', '')) AS ungapped_seqlen FROM r")
def stat_len(s, d):
    return basic.stat(reads(s, d), "seqlen,ungapped_seqlen")


@query(f"WITH {D} SELECT id, length(seq) - length(translate(seq, 'eE', '')) AS e, length(seq) - length(translate(seq, '0123456789', '')) AS digits FROM d")
def stat_charcount(s, d):
    return basic.stat(documents(s, d), ["charcount(eE)", "charcount('0123456789')"], names=["e", "digits"])


@query(f"WITH {A} SELECT id, CASE WHEN t > 0 THEN round(g / t, 9) ELSE 'NaN'::DOUBLE END AS gc FROM (SELECT id, CAST(length(seq) - length(translate(seq, 'GC', '')) AS DOUBLE) AS g, length(seq) - length(translate(seq, 'ACGTU', '')) AS t FROM a)")
def stat_gc(s, d):
    return basic.stat(amplicons(s, d), "gc").withColumn("gc", F.round("gc", 9))


@query(f"WITH {R} SELECT id, round(list_sum([power(10.0, -(ord(c) - 33) / 10.0) FOR c IN string_split(qual, '')]), 6) AS exp_err FROM r WHERE qual <> ''")
def exp_err(s, d):
    return basic.stat(reads(s, d).where("qual <> ''"), "exp_err").withColumn("exp_err", F.round("exp_err", 6))


@query(f"WITH {R} SELECT id, seq FROM r ORDER BY ord LIMIT 100")
def head(s, d):
    return basic.head(reads(s, d), 100).select("id", "seq")


@query(f"WITH {R} SELECT id, seq FROM r ORDER BY ord DESC LIMIT 100")
def tail(s, d):
    return basic.tail(reads(s, d), 100).select("id", "seq")


@query(f"WITH {R} SELECT id, seq FROM r ORDER BY ord LIMIT 51 OFFSET 99")
def slice_records(s, d):
    return basic.slice_records(reads(s, d), 100, 150).select("id", "seq")


@query(f"WITH {R} SELECT id, row_number() OVER (ORDER BY ord) AS seq_num, row_number() OVER (ORDER BY ord) - 1 AS seq_idx FROM r")
def seq_num(s, d):
    return basic.stat(basic.number_records(reads(s, d)), "seq_num,seq_idx")


@query(f"WITH {R} SELECT path, count(*) AS n FROM (SELECT 'part_' || CAST((row_number() OVER (ORDER BY ord) - 1) // 1000 + 1 AS VARCHAR) AS path FROM r) GROUP BY 1")
def split_chunks(s, d):
    return keyed.split_counts(keyed.split_paths(reads(s, d), "part_{chunk}", 1000))


@query("SELECT 'lang_' || coalesce(lang, '') || '.txt' AS path, count(*) AS n FROM documents GROUP BY 1")
def split_counts(s, d):
    return keyed.split_counts(keyed.split_paths(documents(s, d), "lang_{desc}.txt"))


@query(f"WITH {R} SELECT id, seq FROM r ORDER BY ('0x' || md5('7:' || CAST(ord AS VARCHAR))[1:8])::BIGINT, ord LIMIT 500")
def sample_n(s, d):
    return basic.sample_n(reads(s, d), 500, 7).select("id", "seq")


@query(f"WITH {R} SELECT id, seq FROM r WHERE ('0x' || md5('7:' || CAST(ord AS VARCHAR))[1:8])::BIGINT < {int(0.1 * (1 << 32))}")
def sample_share(s, d):
    return basic.sample_share(reads(s, d), 0.1, 7).select("id", "seq")


@query(f"WITH {A} SELECT id, length(seq) AS seqlen FROM a ORDER BY length(seq) DESC, ord LIMIT 200")
def sort_top(s, d):
    return basic.stat(basic.sort(amplicons(s, d), "seqlen", reverse=True).limit(200), "seqlen")


@query(f"WITH {R} SELECT id, seq FROM r ORDER BY seq, ord LIMIT 200")
def sort_seq(s, d):
    return basic.sort(reads(s, d), "seq").limit(200).select("id", "seq")


@query(f"WITH {A} SELECT id, CASE WHEN \"desc\" LIKE '%size=%' THEN regexp_extract(\"desc\", 'size=(\\d+)', 1)::DOUBLE END AS size FROM a ORDER BY 2 DESC NULLS FIRST, ord LIMIT 200")
def sort_attr(s, d):
    ctx = Context(attr_format=AttrFormat(";", "="))
    a = amplicons(s, d).withColumn("desc", F.concat(F.lit(";"), F.col("desc")))
    return basic.stat(basic.sort(a, "{num(opt_attr('size'))}", True, ctx).limit(200), ["{num(opt_attr('size'))}"], ctx, ["size"])


@query(f"WITH {R} SELECT id, row_number() OVER (ORDER BY seq, ord) AS rank FROM r")
def sort_seq_all(s, d):
    return basic.sort_ranks(reads(s, d), "seq").select("id", F.col("_rank").alias("rank"))


@query(f"WITH {A}, k AS (SELECT id, ord, CASE WHEN \"desc\" LIKE '%size=%' THEN regexp_extract(\"desc\", 'size=(\\d+)', 1)::DOUBLE END AS size FROM a) SELECT id, size, row_number() OVER (ORDER BY size DESC NULLS FIRST, ord) AS rank FROM k")
def sort_attr_all(s, d):
    ctx = Context(attr_format=AttrFormat(";", "="))
    a = amplicons(s, d).withColumn("desc", F.concat(F.lit(";"), F.col("desc")))
    ranked = basic.sort_ranks(a, "{num(opt_attr('size'))}", True, ctx)
    return ranked.select("id", compile_template(ctx, "{num(opt_attr('size'))}", raw=True).col.alias("size"), F.col("_rank").alias("rank"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS seq, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey) AS rank FROM orders")
def sort_orders_all(s, d):
    return basic.sort_ranks(records(table(s, d, "orders"), "o_orderkey", "o_orderpriority", order="o_orderkey"), "seq", reverse=True).select("id", "seq", F.col("_rank").alias("rank"))


FIRST = f"WITH {R}, f AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY ord) AS k, count(*) OVER (PARTITION BY seq) AS n_duplicates, first_value(id) OVER (PARTITION BY seq ORDER BY ord) AS ref FROM r)"


@query(FIRST + " SELECT id, \"desc\", seq FROM f WHERE k = 1")
def unique_first(s, d):
    return keyed.unique(reads(s, d), "seq").select("id", "desc", "seq")


@query(FIRST + " SELECT id, n_duplicates, n_duplicates - 1 AS others FROM f WHERE k = 1")
def unique_count(s, d):
    u = keyed.unique(reads(s, d), "seq")
    return basic.stat(u, ["n_duplicates", "n_duplicates(false)"], keyed.unique_context(), ["n_duplicates", "others"])


@query(f"WITH {A} SELECT min_by(id, ord) AS id, string_agg(id, ',' ORDER BY ord) AS duplicates_list FROM a GROUP BY upper(seq)")
def unique_list(s, d):
    return keyed.unique(amplicons(s, d), "upper_seq", with_list=True).select("id", "duplicates_list")


@query(f"WITH {A}, k AS (SELECT id, ord, least(seq, {ANY_COMPLEMENT}) AS s FROM (SELECT id, ord, upper(seq) AS seq FROM a)) SELECT min_by(id, ord) AS id, count(*) AS n FROM k GROUP BY s")
def unique_strand_all(s, d):
    return unique_strand(s, d)


@query(SQL["unique_strand_all"])
def unique_strand(s, d):
    return keyed.unique(amplicons(s, d), "seqhash_min(true)").select("id", F.col("n_duplicates").alias("n"))


@query(FIRST + " SELECT id, ref FROM f")
def map_long(s, d):
    return keyed.unique_map(reads(s, d), "seq", "long")


@query(FIRST + " SELECT id, CASE WHEN k = 1 THEN '*' ELSE ref END AS ref FROM f")
def map_long_star(s, d):
    return keyed.unique_map(reads(s, d), "seq", "long-star")


WIDE = f"WITH {A} SELECT {{}} AS value FROM a GROUP BY seq"


@query(WIDE.format("string_agg(id, chr(9) ORDER BY ord)"))
def map_wide(s, d):
    return keyed.unique_map(amplicons(s, d), "seq", "wide")


@query(WIDE.format("min_by(id, ord) || chr(9) || string_agg(id, ',' ORDER BY ord)"))
def map_wide_comma(s, d):
    return keyed.unique_map(amplicons(s, d), "seq", "wide-comma")


@query(WIDE.format("min_by(seq, ord) || chr(9) || string_agg(id, chr(9) ORDER BY ord)"))
def map_wide_key(s, d):
    return keyed.unique_map(amplicons(s, d), "seq", "wide-key")


CONDITION = "(length(seq) - length(translate(seq, 'ACGT', ''))) / greatest(length(seq), 1) >= 0.99 AND length(seq) >= 60"


@query(f"WITH {R} SELECT id, seq FROM r WHERE {CONDITION}")
def filter_expr(s, d):
    return basic.filter_records(reads(s, d), "charcount('ACGT') / seqlen >= 0.99 && seqlen >= 60").select("id", "seq")


@query(f"WITH {R} SELECT id, seq FROM r WHERE NOT ({CONDITION})")
def filter_dropped(s, d):
    return basic.filter_dropped(reads(s, d), "charcount('ACGT') / seqlen >= 0.99 && seqlen >= 60").select("id", "seq")


@query(f"WITH {R} SELECT id FROM r WHERE list_sum([power(10.0, -(ord(c) - 33) / 10.0) FOR c IN string_split(qual, '')]) < 0.5 AND length(seq) >= 40 AND qual <> ''")
def filter_quality(s, d):
    return basic.filter_records(reads(s, d).where("qual <> ''"), "exp_err < 0.5 && seqlen >= 40").select("id")


@query(f"WITH {R} SELECT id, CASE WHEN length(seq) > 70 THEN 'long' WHEN id LIKE '1%' THEN substr(id, 2, 2) ELSE 'other' END AS kind FROM r")
def js_branches(s, d):
    return basic.stat(reads(s, d), ["{if (seqlen > 70) return 'long'; if (id.startsWith('1')) { return id.substring(1, 3); } else return 'other';}"], names=["kind"])


@query(f"WITH {R} SELECT id, \"desc\", seq || 'A' AS seq FROM r")
def js_concat(s, d):
    return basic.set_fields(reads(s, d), seq="{seq + 'A'}").select("id", "desc", "seq")


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT)::VARCHAR AS quantity FROM lineitem")
def number_text(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.format_double(F.col("l_quantity")).alias("quantity"))


RUNS = "x AS (SELECT rec_no, run_id, coalesce(seq, '') AS seq FROM csv_records)"


def by_run(s: SparkSession, d: str) -> DataFrame:
    return records(table(s, d, "csv_records"), "run_id", "seq", None, None, "rec_no")


@query(f"WITH {RUNS} SELECT rec_no AS ord FROM x WHERE run_id IN (SELECT run_id FROM seq_runs)")
def has_meta(s, d):
    return keyed.has_meta(by_run(s, d), table(s, d, "seq_runs"), "run_id").select(F.col("_ord").alias("ord"))


@query(f"WITH {RUNS} SELECT rec_no AS ord FROM x WHERE coalesce(run_id, '') NOT IN (SELECT run_id FROM seq_runs)")
def anti_meta(s, d):
    df, ctx = keyed.with_meta(by_run(s, d), table(s, d, "seq_runs"))
    return basic.filter_records(df, "!has_meta()", ctx).select(F.col("_ord").alias("ord"))


@query(f"WITH {RUNS} SELECT rec_no AS ord, qual_fmt, coalesce(instrument, 'undefined') || '/' || coalesce(flowcell, 'undefined') AS device FROM x LEFT JOIN seq_runs USING (run_id)")
def opt_meta(s, d):
    df, ctx = keyed.with_meta(by_run(s, d), table(s, d, "seq_runs"))
    v = basic.stat(df.withColumn("id", F.col("_ord").cast("string")), ["opt_meta(qual_fmt)", "{opt_meta(instrument)}/{opt_meta(3)}"], ctx, ["qual_fmt", "device"])
    return v.select(F.col("id").cast("bigint").alias("ord"), "qual_fmt", "device")


CMP = f"WITH {R}, {A}, j AS (SELECT r.id AS id1, a.id AS id2, CASE WHEN a.ord IS NULL THEN 'unique1' WHEN r.ord IS NULL THEN 'unique2' ELSE 'common' END AS category FROM r FULL JOIN a ON r.id = a.id)"


def two(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two whole collections whose ids overlap."""
    return reads(s, d), amplicons(s, d)


@query(CMP + " SELECT c.category, count(j.category) AS n FROM (VALUES ('common'), ('unique1'), ('unique2')) AS c(category) LEFT JOIN j USING (category) GROUP BY 1")
def cmp_stats(s, d):
    return keyed.compare_stats(*two(s, d), "id")


@query(CMP + " SELECT id1, id2, category FROM j")
def cmp_category(s, d):
    return keyed.compare(*two(s, d), "id").select("id1", "id2", "category")


@query(CMP + " SELECT id1 AS id FROM j WHERE category = 'common'")
def cmp_common(s, d):
    return keyed.intersect(*two(s, d), "id").select("id")


@query(CMP + " SELECT id1 AS id FROM j WHERE category = 'unique1'")
def cmp_unique1(s, d):
    return keyed.difference(*two(s, d), "id").select("id")


@query(CMP + " SELECT id2 AS id FROM j WHERE category = 'unique2'")
def cmp_unique2(s, d):
    return keyed.difference(*reversed(two(s, d)), "id").select("id")


@query(f"WITH {R}, {A}, l AS (SELECT seq, ord, row_number() OVER (PARTITION BY seq ORDER BY ord) AS i FROM r), m AS (SELECT seq, ord, row_number() OVER (PARTITION BY seq ORDER BY ord) AS i FROM a) SELECT CASE WHEN m.ord IS NULL THEN 'u1' WHEN l.ord IS NULL THEN 'u2' ELSE 'c' END AS category_short, count(*) AS n FROM l FULL JOIN m ON l.seq = m.seq AND l.i = m.i GROUP BY 1")
def cmp_repeated(s, d):
    return keyed.compare(*two(s, d), "seq", unordered_duplicates=True).groupBy("category_short").agg(F.count(F.lit(1)).alias("n"))


ZIP = f"WITH {A}, z AS (SELECT *, row_number() OVER (ORDER BY ord) AS p FROM a)"


@query(ZIP + " SELECT id, seq, 2 * (p - 1) + i AS ord FROM z, (VALUES (0), (1)) AS t(i)")
def interleave(s, d):
    a = amplicons(s, d)
    return keyed.interleave(a, a).select("id", "seq", F.col("_ord").alias("ord"))


@query(ZIP + f" SELECT id, seq || 'NNN' || {ANY_COMPLEMENT} AS seq, p AS ord FROM z")
def concat_all(s, d):
    return concat(s, d)


@query(SQL["concat_all"])
def concat(s, d):
    a = amplicons(s, d)
    return keyed.concat(a, basic.revcomp(a), spacer=3).select("id", "seq", F.col("_ord").alias("ord"))


@query(f"WITH {D} SELECT id, translate(seq, '{UP}', '{LOW}') AS seq FROM d")
def lower(s, d):
    return basic.lower(documents(s, d)).select("id", "seq")


@query(f"WITH {D} SELECT id, translate(seq, '{LOW}', '{UP}') AS seq FROM d")
def upper(s, d):
    return basic.upper(documents(s, d)).select("id", "seq")


@query(f"WITH {R} SELECT id, {COMPLEMENT} AS seq, reverse(qual) AS qual FROM r")
def revcomp(s, d):
    return basic.revcomp(reads(s, d), "dna").select("id", "seq", "qual")


@query(f"WITH {R} SELECT id, substr(seq, 3, greatest(length(seq) - 4, 0)) || right(seq, 3) AS seq FROM r")
def trim(s, d):
    return basic.trim(reads(s, d), "3:-3,-3:").select("id", "seq")


@query(f"WITH {R} SELECT id, substr(seq, 1, 4) || translate(substr(seq, 5, 6), '{UP}', '{LOW}') || substr(seq, 11) AS seq FROM r")
def mask(s, d):
    return basic.mask(reads(s, d), "5:10").select("id", "seq")


@query(f"WITH {R} SELECT id, repeat('N', least(length(seq), 5)) || substr(seq, 6) AS seq FROM r")
def mask_hard(s, d):
    return basic.mask(reads(s, d), ":5", hard="N").select("id", "seq")


@query(f"WITH {R} SELECT 'rec_' || id AS id, 'len=' || CAST(length(seq) AS VARCHAR) || ' ' || coalesce(\"desc\", '') AS \"desc\" FROM r")
def set_template(s, d):
    return basic.set_fields(reads(s, d), id="rec_{id}", desc="len={seqlen} {desc}").select("id", "desc")


@query(f"WITH {R} SELECT id, replace(seq, 'T', 'U') AS seq FROM r")
def replace_lit(s, d):
    return basic.replace(reads(s, d), "T", "U").select("id", "seq")


@query(f"WITH {D} SELECT id, regexp_replace(seq, '([0-9]+)\\.([0-9]+)', '\\2,\\1', 'g') AS seq FROM d")
def replace_re(s, d):
    return basic.replace(documents(s, d), r"([0-9]+)\.([0-9]+)", "$2,$1", regex=True).select("id", "seq")


TILE = "CASE WHEN regexp_matches(\"desc\", '(^| )tile=') THEN nullif(regexp_extract(\"desc\", '(?:^| )tile=([^ ]*)', 1), 'undefined') END"


@query(f"WITH {R} SELECT id, {TILE} AS tile, {TILE} IS NOT NULL AS has_tile FROM r")
def attr_get(s, d):
    return basic.stat(reads(s, d), ["opt_attr(tile)", "has_attr(tile)"], names=["tile", "has_tile"])


@query(f"WITH {R} SELECT id, CASE WHEN regexp_matches(\"desc\", '(^| )tile=') THEN regexp_replace(\"desc\", '((?:^| )tile=)[^ ]*', '\\1' || CAST(length(seq) AS VARCHAR)) WHEN coalesce(\"desc\", '') = '' THEN 'tile=' || CAST(length(seq) AS VARCHAR) ELSE \"desc\" || ' tile=' || CAST(length(seq) AS VARCHAR) END AS \"desc\" FROM r")
def attr_edit(s, d):
    return basic.set_attrs(reads(s, d), edit={"tile": "{seqlen}"}).select("id", "desc")


@query(f"WITH {R} SELECT id, CASE WHEN coalesce(\"desc\", '') = '' THEN '' ELSE \"desc\" || ' ' END || 'n=' || CAST(length(seq) AS VARCHAR) AS \"desc\" FROM r")
def attr_append(s, d):
    return basic.set_attrs(reads(s, d), append={"n": "{seqlen}"}).select("id", "desc")


@query(f"WITH {R} SELECT id, CASE WHEN regexp_matches(\"desc\", '^tile=') THEN regexp_replace(\"desc\", '^tile=[^ ]* ?', '') ELSE regexp_replace(\"desc\", ' tile=[^ ]*', '') END AS \"desc\" FROM r")
def attr_delete(s, d):
    return basic.delete(reads(s, d), attrs=["tile"]).select("id", "desc")


@query("SELECT CAST(event_id AS VARCHAR) AS id, regexp_extract(props, '\"k\": (\\d+)', 1) AS k FROM events")
def attr_json(s, d):
    e = records(table(s, d, "events"), "event_id", "event_type", "props", None, "event_id").withColumn("desc", F.regexp_replace("desc", r'^\{"k": ([0-9]+)\}$', "k=$1"))
    return basic.stat(e, ["attr(k)"], names=["k"])


PATTERN = "GATTACA"
STARTS = f"length(string_split(seq, '{PATTERN}')[1]) + 1"


@query(f"WITH {A} SELECT id, len(string_split(seq, '{PATTERN}')) - 1 AS n FROM a WHERE contains(seq, '{PATTERN}')")
def find_count(s, d):
    f = search.matched(search.find(amplicons(s, d), search.Search(search.pattern_of(PATTERN))))
    return f.select("id", F.size(F.element_at("_m", 1)["hits"]).cast("bigint").alias("n"))


@query(f"WITH {A} SELECT id, seq FROM a WHERE contains(seq, '{PATTERN}')")
def find_filter(s, d):
    return amplicons(s, d).where(search.has_match(search.Search(search.pattern_of(PATTERN)))).select("id", "seq")


@query(f"WITH {A} SELECT id, seq FROM a WHERE NOT contains(seq, '{PATTERN}')")
def find_exclude(s, d):
    return amplicons(s, d).where(~search.has_match(search.Search(search.pattern_of(PATTERN)))).select("id", "seq")


@query(f"WITH {A} SELECT id, CAST({STARTS} AS VARCHAR) || ':' || CAST({STARTS} + {len(PATTERN) - 1} AS VARCHAR) AS \"range\", {STARTS} - 1 - length(seq) AS neg_start FROM a WHERE contains(seq, '{PATTERN}')")
def find_range(s, d):
    se = search.Search(search.pattern_of(PATTERN))
    f = search.matched(search.find(amplicons(s, d), se))
    return basic.stat(f, "match_range,match_neg_start", search.find_context(se), ["range", "neg_start"]).withColumn("neg_start", F.col("neg_start").cast("bigint"))


REGEX = r"seqtable@(\d+)\.(\d+)"


@query(f"WITH {D} SELECT id, regexp_extract(seq, '{REGEX}', 1) AS major, regexp_extract(seq, '{REGEX}', 2) AS minor FROM d WHERE regexp_matches(seq, '{REGEX}')")
def find_group(s, d):
    se = search.Search(search.pattern_of(REGEX), regex=True)
    f = search.matched(search.find(documents(s, d), se))
    return basic.stat(f, "match_group(1),match_group(2)", search.find_context(se), ["major", "minor"])


@query(f"WITH {D} SELECT id FROM d WHERE regexp_matches(seq, 'lane \\d+ (gave|only)')")
def find_regex(s, d):
    return documents(s, d).where(search.has_match(search.Search(search.pattern_of(r"lane \d+ (gave|only)"), regex=True))).select("id")


MULTI = (("p1", "GATTACA"), ("p2", "CCCGGG"), ("p3", "TTTAAAT"))


@query(f"WITH {A} SELECT id, CASE WHEN contains(seq, 'GATTACA') THEN 'p1' WHEN contains(seq, 'CCCGGG') THEN 'p2' ELSE 'p3' END AS pattern_name FROM a WHERE contains(seq, 'GATTACA') OR contains(seq, 'CCCGGG') OR contains(seq, 'TTTAAAT')")
def find_multi(s, d):
    se = search.Search(MULTI)
    return basic.stat(search.matched(search.find(amplicons(s, d), se)), "pattern_name", search.find_context(se))


@query(f"WITH {A} SELECT id, replace(seq, '{PATTERN}', '<' || '{len(PATTERN)}' || '>') AS seq FROM a WHERE contains(seq, '{PATTERN}')")
def find_replace(s, d):
    se = search.Search(search.pattern_of(PATTERN))
    return search.replace_hits(search.matched(search.find(amplicons(s, d), se)), se, "<{match_len}>").select("id", "seq")


@query(f"WITH {A} SELECT id, length(regexp_extract(seq, '^(.*?)GA[AG]TT[ACGTMRWSYKVHDB]CA', 1)) + 1 AS match_start FROM a WHERE regexp_matches(seq, 'GA[AG]TT[ACGTMRWSYKVHDBN]CA')")
def find_ambiguous(s, d):
    se = search.Search(search.pattern_of("GARTTNCA"))
    f = search.matched(search.find(amplicons(s, d), se, hits="best"))
    return basic.stat(f, "match_start", search.find_context(se)).withColumn("match_start", F.col("match_start").cast("bigint"))


@query()
def find_approx(s, d):
    """A primer near the start with up to four differences, with its alignment."""
    se = search.Search(search.pattern_of("GTCTCGAGTTTGACTAATTG", "fwd"), max_diffs=4, anchor_start=4)
    f = search.matched(search.find(amplicons(s, d), se))
    return basic.stat(f, "pattern_name,match_range,match_diffs,match_ins,match_del,match_subst,aligned_match,aligned_pattern", search.find_context(se))


@query("SELECT CAST(rec_no AS VARCHAR) AS id, translate(qual, (SELECT string_agg(chr(i::INT), '' ORDER BY i) FROM range(33, 96) AS t(i)), (SELECT string_agg(chr((i + 31)::INT), '' ORDER BY i) FROM range(33, 96) AS t(i))) AS qual FROM csv_records WHERE qual <> ''")
def quality_convert(s, d):
    r = reads(s, d).where("qual <> ''")
    return r.select("id", sequence.convert_quality(F.col("qual"), "sanger", "illumina").alias("qual"))


@query("SELECT CAST(rec_no AS VARCHAR) AS id, array_to_string([CAST(ord(c) - 33 AS VARCHAR) FOR c IN string_split(qual, '')], ' ') AS scores FROM csv_records WHERE qual <> ''")
def quality_scores(s, d):
    return reads(s, d).where("qual <> ''").select("id", sequence.phred_list(F.col("qual")).alias("scores"))


@query(f"WITH {R} SELECT '>' || id || coalesce(' ' || \"desc\", '') || chr(10) || rtrim(regexp_replace(replace(seq, chr(10), ''), '(.{{20}})', '\\1' || chr(10), 'gs'), chr(10)) AS value FROM r")
def fasta_text(s, d):
    from ..sources.files import as_fasta

    return as_fasta(basic.replace(reads(s, d), "\n", ""), wrap=20)


@query(f"WITH {R} SELECT id || chr(9) || coalesce(CAST(length(seq) AS VARCHAR), '') || chr(9) || coalesce({TILE}, 'undefined') AS value FROM r")
def tsv_text(s, d):
    from ..sources.files import as_delimited

    return as_delimited(reads(s, d), "\t", "id,seqlen,opt_attr(tile)")


@query("SELECT CAST(l_linenumber AS VARCHAR) AS key1, l_returnflag AS key2, count(*) AS n FROM lineitem GROUP BY 1, 2")
def count_lineitem(s, d):
    r = records(table(s, d, "lineitem"), "l_linenumber", "l_returnflag")
    return basic.count_by(r, "id,seq")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS seq FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 300")
def sort_orders(s, d):
    return basic.sort(records(table(s, d, "orders"), "o_orderkey", "o_orderpriority", order="o_orderkey"), "seq", reverse=True).limit(300).select("id", "seq")
