"""Queries of this package and, where SQL can say the same on whole tables, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage, table
from . import encode, format_copies, frequent, near_copies, packing, pii


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return format_copies.copies_found(table(spark, d, "csv_records"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    groups, _ = format_copies.copy_groups(table(spark, d, "csv_records"))
    return groups.select(F.col("first_no").alias("first_rec_no"), "copies")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.near_pairs(table(spark, d, "amplicons"), "amp_no", "seq")


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.near_classes(table(spark, d, "amplicons"), "amp_no", "seq")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent.frequent_values(table(spark, d, "csv_records"), "seq", 0.004).select(F.col("value").alias("seq"))


def p4_top(spark: SparkSession, d: str) -> DataFrame:
    return frequent.top_values(table(spark, d, "csv_records"), "seq", 100).select(F.col("value").alias("seq"), "n")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of p7_pack: texts placed, pieces of texts that may not be split, containers beyond their capacity, pieces that overlap, ids lost, and the containers that are more than the least possible number by a tenth."""
    docs = table(spark, d, "documents")
    placed = stage(p7_pack(spark, d), "packed")
    sizes = encode.count_ids(docs).where("n_ids > 0")
    by_doc = placed.groupBy("doc_id").agg(F.sum("n_ids").alias("ids"), F.count(F.lit(1)).alias("parts"))
    whole = sizes.join(by_doc, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if((F.col("n_ids") <= 4096) & (F.col("parts") > 1)).alias("split"), F.count_if(F.col("ids").isNull() | (F.col("ids") != F.col("n_ids"))).alias("lost"), F.sum("n_ids").alias("total")
    )
    after = F.lag(F.col("position") + F.col("n_ids")).over(Window.partitionBy("container").orderBy("position"))
    boxes = placed.withColumn("gap", F.col("position") - F.coalesce(after, F.lit(0))).groupBy("container").agg(F.sum("n_ids").alias("ids"), F.count_if(F.col("gap") != 0).alias("gaps"))
    filled = boxes.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ids") > 4096).alias("beyond"), F.sum("gaps").alias("overlaps"))
    one = F.lit(1).alias("one")  # both have one row
    return whole.select("*", one).join(filled.select("*", one), "one").select("texts", "split", "lost", "beyond", "overlaps", (F.col("n") > F.ceil(F.col("total") / 4096) * 1.1).alias("wasteful"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    spans = pii.find_pii(table(spark, d, "documents"), table(spark, d, "name_parts"))
    return spans.select("doc_id", "pii_type", "pii_text").distinct()


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return pii.redact(docs, pii.find_pii(docs, table(spark, d, "name_parts")))


CANON = r"""
keyed AS (
  SELECT rec_no, regexp_replace(upper(seq), '[^\p{L}]', '', 'g') AS letters,
    string_split(regexp_replace(descr, '(^|[^\p{L}\p{N}])(tile|x|y|size|site|primer|depth|buffer|plate)[\s\p{Z}]*(:=|=|:)', chr(1) || '\2' || chr(2), 'gi'), chr(1)) AS parts
  FROM csv_records WHERE seq <> '' AND descr <> ''),
canon AS (
  SELECT rec_no, letters, regexp_replace(lower(parts[1]), '[^\p{L}\p{N}]', '', 'g') AS heading,
    list_sort(list_distinct([lower(string_split(p, chr(2))[1]) || '=' || regexp_replace(lower(string_split(p, chr(2))[2]), '[^\p{L}\p{N}]', '', 'g') FOR p IN parts[2:]])) AS fields
  FROM keyed),
firsts AS (SELECT rec_no, min(rec_no) OVER (PARTITION BY letters, heading, fields) AS first_rec_no FROM canon)
"""

QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_classes": p2_classes, "p4_found": p4_found, "p4_top": p4_top, "p6_ids": p6_ids, "p7_pack": p7_pack, "p7_invariants": p7_invariants, "p8_found": p8_found, "p8_redacted": p8_redacted}

PAIRS = """
g AS (SELECT DISTINCT amp_no, unnest([upper(seq)[i:i + 7] FOR i IN range(1, length(seq) - 6)]) AS w FROM amplicons WHERE length(seq) >= 8),
n AS (SELECT amp_no, count(*) AS n FROM g GROUP BY 1),
s AS (SELECT a.amp_no AS a, b.amp_no AS b, count(*) AS shared FROM g a JOIN g b ON a.w = b.w AND a.amp_no < b.amp_no GROUP BY 1, 2),
pairs AS (SELECT a, b FROM s JOIN n x ON x.amp_no = a JOIN n y ON y.amp_no = b WHERE shared >= 0.6 * (x.n + y.n - shared) - 1e-9)
"""

SQL = {
    "p2_found": f"WITH {PAIRS} SELECT a AS amp_no_a, b AS amp_no_b FROM pairs",
    "p2_classes": f"""WITH RECURSIVE {PAIRS}, both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(id, other) AS (SELECT amp_no, amp_no FROM n UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
others AS (SELECT e.a AS id, count(DISTINCT upper(y.seq)) AS n_links FROM both_ways e JOIN amplicons x ON x.amp_no = e.a JOIN amplicons y ON y.amp_no = e.b WHERE upper(x.seq) <> upper(y.seq) GROUP BY 1)
SELECT n.amp_no, min(r.other) AS class_id, any_value(coalesce(o.n_links, 0)) AS n_links FROM n JOIN reach r ON r.id = n.amp_no LEFT JOIN others o ON o.id = n.amp_no GROUP BY 1""",
    "p7_invariants": "SELECT count(*) AS texts, 0 AS split, 0 AS lost, 0 AS beyond, 0 AS overlaps, false AS wasteful FROM documents WHERE text <> ''",
    "p1_found": f"WITH {CANON} SELECT first_rec_no, rec_no FROM firsts WHERE first_rec_no <> rec_no",
    "p1_groups": f"WITH {CANON} SELECT first_rec_no, count(*) AS copies FROM firsts GROUP BY 1",
    "p4_found": "SELECT seq FROM csv_records WHERE seq IS NOT NULL GROUP BY seq HAVING count(*) >= 0.004 * (SELECT count(seq) FROM csv_records)",
    "p4_top": "SELECT seq, count(*) AS n FROM csv_records WHERE seq IS NOT NULL GROUP BY seq ORDER BY n DESC, seq LIMIT 100",
}
