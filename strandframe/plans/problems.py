"""Queries of the data-loading operators: rejected lines and units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import rejects, units
from ..session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejects(table(spark, d, "raw_lines"), table(spark, d, "file_layouts"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return rejects.records(table(spark, d, "raw_lines"), table(spark, d, "file_layouts"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return units.phred_sums(table(spark, d, "score_sets"), table(spark, d, "seq_runs"))


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    return units.level_segments(table(spark, d, "score_sets"))


P3 = r"""
WITH l AS (SELECT line_no, y.*, regexp_replace(coalesce(raw_line, ''), '\r\z', '') AS t, CASE WHEN delim IN ('|', ';', ',', ':', '.', '+', '*', '?', '^', '$') THEN '[' || delim || ']' ELSE delim END AS e,
    '[^"' || CASE WHEN delim = '^' THEN '\^' ELSE delim END || ']' AS plain
  FROM raw_lines r JOIN file_layouts y ON r.layout_id = y.layout_id),
m AS (SELECT *, '(?:"(?:[^"]|"")*"|' || plain || '*)' AS f FROM l),
q AS (SELECT *, regexp_full_match(t, f || '(?:' || e || f || ')*', 's') AS quoted_right FROM m),
c AS (SELECT *, CASE WHEN quoted_right THEN regexp_extract_all(t, '(' || f || ')(?:' || e || '|\z)', 1, 's') END AS fields FROM q),
n AS (SELECT *, CASE WHEN quoted_right THEN length(regexp_replace(regexp_replace(t, '"(?:[^"]|"")*"', '', 'gs'), '[^' || CASE WHEN delim = '^' THEN '\^' ELSE delim END || ']', '', 'gs')) + 1 END AS n_fields FROM c),
v AS (SELECT *, CASE WHEN n_fields = n_cols THEN list_transform(fields, lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) END AS val FROM n),
s AS (SELECT *, val[seq_col + 1] AS seq, CASE WHEN qual_col IS NOT NULL THEN val[qual_col + 1] END AS qual, val[id_col + 1] AS id, CASE WHEN desc_col IS NOT NULL THEN val[desc_col + 1] END AS descr FROM v),
z AS (SELECT *, CASE WHEN NOT quoted_right THEN 'quoting' WHEN n_fields <> n_cols THEN 'columns'
  WHEN NOT regexp_full_match(seq, '[ACGTUNRYSWKMBDHVacgtunryswkmbdhv.-]+') THEN 'seq'
  WHEN qual <> '' AND (length(qual) <> length(seq) OR NOT regexp_full_match(qual, CASE qual_fmt WHEN 'illumina' THEN '[@-~]*' WHEN 'solexa' THEN '[;-~]*' ELSE '[!-~]*' END)) THEN 'qual' END AS reason FROM s)
"""

# The names of P5 as patterns; a segment of level shifts changes nothing where names and codes agree, which holds for these tables.
P5_FORMER = r"(^|[^\p{L}\p{N}_])(was|were|formerly|originally|previously|(converted|decoded|recoded|changed|translated|moved) from)\s+(in\s+|as\s+)?(sang[a-z]*|il+umina|solex[a-z]*|phred)([\s_]*1\.[0-9]+(-1\.[0-9]+)?\+?)?"


def _p5_named(t: str, edits: int, numbers: str) -> str:
    like = lambda word, n=edits: rf"list_bool_or([levenshtein(w, '{word}') <= {n} FOR w IN regexp_split_to_array({t}, '[^\p{{L}}]+')])"
    at = lambda n: rf"regexp_matches({t}, '(offset|phred|ascii|sanger|illumina|solexa)\s*\(?\+?\s*(offset\s*)?{n}([^0-9]|$)|\+{n}([^0-9]|$)')"
    return rf"""CASE WHEN {like('solexa')} THEN 'solexa'
      WHEN {like('illumina')} THEN CASE WHEN regexp_matches({t}, '1[._](8|9|[1-9][0-9])([^0-9]|$)') THEN 'sanger' ELSE 'illumina' END
      WHEN {like('sanger')} THEN 'sanger' WHEN {at(33)} THEN 'sanger' WHEN {at(64)} THEN 'illumina'
      WHEN {like('phred', 1 if edits > 1 else 0)} OR regexp_matches({t}, '{numbers}') THEN 'phred' END"""


P5 = rf"""
WITH s AS (SELECT DISTINCT set_no, run_id, scores, trim(lower(orig_format)) AS label, regexp_replace(lower(remark), '{P5_FORMER}', ' ', 'g') AS now FROM score_sets WHERE scores <> ''),
y AS (SELECT run_id, trim(lower(qual_fmt)) AS q FROM seq_runs),
n AS (SELECT set_no, scores, CASE WHEN label IS NOT NULL THEN coalesce({_p5_named("label", 2, "(^|[^a-z])qual([^a-z]|$)")}, CASE WHEN label IN ('fq', 'fastq') THEN 'sanger' END)
    ELSE coalesce(CASE WHEN now IS NOT NULL THEN {_p5_named("now", 1, "(^|[^a-z])qual (file|numbers)|[.]qual")} END, {_p5_named("q", 2, "(^|[^a-z])qual([^a-z]|$)")}) END AS fmt
  FROM s LEFT JOIN y USING (run_id)),
v AS (SELECT set_no, fmt, CASE WHEN fmt = 'phred' THEN [x::BIGINT FOR x IN regexp_extract_all(scores, '-?[0-9]+')] ELSE [ascii(c)::BIGINT FOR c IN string_split(scores, '')] END AS x FROM n WHERE fmt IS NOT NULL)
SELECT DISTINCT set_no, fmt AS orig_format, list_sum(CASE fmt WHEN 'phred' THEN x WHEN 'sanger' THEN [c - 33 FOR c IN x] WHEN 'illumina' THEN [c - 64 FOR c IN x]
  ELSE [floor(10 * log10(10.0 ** ((c - 64) / 10.0) + 1) + 0.5)::BIGINT FOR c IN x] END)::BIGINT AS phred_sum FROM v
"""

QUERIES = {"p3_found": p3_found, "p3_records": p3_records, "p5_found": p5_found, "p5_segments": p5_segments}

SQL = {
    "p5_found": P5,
    "p3_found": P3 + "SELECT line_no, reason FROM z WHERE reason IS NOT NULL",
    "p3_records": P3 + "SELECT line_no, layout_id, id, descr, seq, qual FROM z WHERE reason IS NULL",
}
