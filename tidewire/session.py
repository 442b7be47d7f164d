"""Spark session defaults and durable intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group of a saved table: what a task that writes or reads it holds, and what reads are dealt by.
ROW_GROUP = 16 << 20

def session(app: str = "tidewire", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TIDEWIRE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on a single machine (a local master, as in tests) may the setting be absent: then a temporary
    folder is made. A cluster without it is refused, since each executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidewire-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewire-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def gathered(df: DataFrame) -> DataFrame:
    """``df``, computed by as many tasks as before, in no more partitions than there are cores: :func:`saved`
    then writes a few files. For results much smaller than what they are computed of."""
    return df.hint("rebalance").coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))


def merged(df: DataFrame, source: DataFrame, bytes_each: int = 128 << 20) -> DataFrame:
    """``df``, computed row by row of ``source``, in fewer and larger partitions without a shuffle: one a core, or
    more, so that none is of more than about ``bytes_each`` of ``source`` by the optimizer's estimate."""
    held = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = max(1, df.sparkSession.sparkContext.defaultParallelism)
    return df.coalesce(min(max(cores, -(-held // bytes_each)), (1 << 31) - 1))


def forget(*tables: DataFrame) -> None:
    """Delete what :func:`saved` wrote for ``tables``; only what no later result reads may be forgotten."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
