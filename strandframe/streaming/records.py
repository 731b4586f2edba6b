"""Record operators on streams: stateless ones as they are, counting and unique with state."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.template import compile_keys
from ..lang.variables import Context
from ..session import drop_path, shared_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_delimited(spark: SparkSession, folder: str, delim: str = "\t", max_files: int = 100) -> DataFrame:
    """Lines of files that arrive in a folder as records (id, desc, seq) with ``loaded_at``; short lines are filled with ''."""
    cols = F.split("value", "\\Q" + delim + "\\E", -1)
    pick = lambda i: F.coalesce(F.get(cols, F.lit(i)), F.lit(""))
    raw = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    return raw.where(F.col("value") != "").select(pick(0).alias("id"), pick(1).alias("desc"), pick(2).alias("seq"), F.lit(None).cast("string").alias("qual"), F.current_timestamp().alias("loaded_at"))


def count_stream(df: DataFrame, keys: str | list[str], ctx: Context | None = None) -> DataFrame:
    """Counts by printed key; write it in complete or update mode."""
    vs = compile_keys(ctx or Context(), keys)
    return df.groupBy(*(v.printed().alias(f"key{i + 1}" if len(vs) > 1 else "key") for i, v in enumerate(vs))).agg(F.count(F.lit(1)).alias("n"))


def unique_stream(df: DataFrame, keys: str | list[str], time: str = "loaded_at", delay: str = "1 hour", ctx: Context | None = None) -> DataFrame:
    """The first record of each key to arrive within the watermark; state older than that is dropped.

    The state holds a SHA-256 of each key, so neither it nor the shuffle grows with the length of texts.
    """
    vs = compile_keys(ctx or Context(), keys)
    names = [f"_k{i}" for i in range(len(vs))]
    digests = {n: F.unhex(F.sha2(v.printed(), 256)) for n, v in zip(names, vs)}
    return df.withColumns(digests).withWatermark(time, delay).dropDuplicatesWithinWatermark(names).drop(*names)


def run_available(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs all that is available and returns it, also as the view ``name``.

    Appended rows are written to the shared folder, so their number has no bound; complete and updated results are
    tables in the driver's memory, for small results such as counts. A new query keeps its state in RocksDB, on disk.
    """
    spark = df.sparkSession
    append = mode == "append"
    own = f"{shared_dir(spark)}/streamed-{uuid.uuid4().hex}"
    w = df.writeStream.queryName(name).outputMode(mode).trigger(availableNow=True)
    if append:
        atexit.register(drop_path, spark, own)
        w = w.format("parquet").option("path", f"{own}/rows")
        checkpoint = checkpoint or f"{own}/state"
    else:
        w = w.format("memory")
    w = w.option("checkpointLocation", checkpoint) if checkpoint else w
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        q = w.start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    q.awaitTermination()
    if append:
        spark.read.schema(df.schema).parquet(f"{own}/rows").createOrReplaceTempView(name)
    return spark.table(name)
