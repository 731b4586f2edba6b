"""Counters of a run, gathered while it writes, without a pass of their own."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, name: str = "n_records", **sums) -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows, and further sums, into the returned observation when an action runs."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias(name), *(F.sum(c.cast("bigint")).alias(n) for n, c in sums.items())), o


def as_json(*observations: Observation) -> str:
    out: dict = {}
    for o in observations:
        out |= o.get
    return json.dumps(out)
