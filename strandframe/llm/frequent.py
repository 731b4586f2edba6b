"""Most frequent values of a column, by exact aggregation that may spill.

groupBy counts on the map side first, so a value with a third of all rows is sent once per
task; the hash partitions of the final count spill to disk when memory ends. The ordered
limit is a local top-k of each partition and one merge of these at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, n) of each distinct non-null value, byte for byte as written; '' is a value. Empty table: no rows."""
    return df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent values; ties go to the smaller value."""
    return value_counts(df, col).orderBy(F.desc("n"), "value").limit(k)


def frequent_values(df: DataFrame, col: str, share: float) -> DataFrame:
    """Values that hold at least ``share`` of the non-null rows, with their counts.

    At most 1 / share values can; so the ordered limit at that number loses none.
    """
    counts = value_counts(df, col)
    total = df.agg(F.count(F.col(col)).alias("total"))
    top = counts.orderBy(F.desc("n"), "value").limit(int(1 / share) + 1)
    return top.where(F.col("n") >= F.lit(share) * total.scalar())
