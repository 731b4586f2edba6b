"""Places and helpers that operators share: the staging folder, written stages, table reading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Where that is unset, a session in one process (tests) gets a folder of its own; on a cluster that is an error, as no
    folder of this machine is seen by all executors.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = getattr(shared_dir, "own", None)
        if d is None:
            d = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="strandframe-")
            atexit.register(shutil.rmtree, d.removeprefix("file://"), True)
        spark.sparkContext.setCheckpointDir(d)
    return d


def drop_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; what is left lies in the staging folder
        pass


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage with a copy that outlives any executor, and keeps Python
    work from running again for each later use. The shuffle files of the write are removed when it is done, as nothing
    reads them again. The copy is dropped by ``release``, or when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._staged = path
    atexit.register(drop_path, spark, path)
    return out


def release(*staged: DataFrame) -> None:
    """Drop copies made by ``stage`` that nothing reads any more."""
    for df in staged:
        drop_path(df.sparkSession, df._staged)


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    """A session for tests and the benchmark."""
    n = cpus or os.cpu_count()
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
