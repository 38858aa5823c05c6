"""Intermediate results as tables: a lineage cut that survives lost executors."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Without it only a local session has one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/corrobix-{os.getpid()}"


#: Bytes of input for each partition of a shuffle before Spark puts small ones together, and what a task then reads at most.
BYTES_A_PARTITION, BYTES_A_TASK = 4 << 20, 16 << 20
_TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events")


def bounded_tasks(spark: SparkSession, sf_dir: str) -> None:
    """Let the number of tasks grow with the tables, so that a task's memory does not.

    Shuffles begin with partitions by the size of the input, never fewer than the session asks for, and AQE puts small ones
    together; a scan's split is an eighth of the default at most, as a cube's Parquet holds millions of rows in that.
    """
    total = 0
    for name in _TABLES:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(at):
            total += fs.getContentSummary(at).getLength()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BYTES_A_PARTITION)))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(BYTES_A_TASK))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(BYTES_A_TASK))


#: Tables written inside each open `scratch`, innermost last.
_open: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that queries write inside are dropped at the end: use their results inside, or write them.

    >>> with scratch(spark):
    ...     queries["score_combined"](spark, folder).write.parquet(out)
    """
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """The same rows, computed once, written as Parquet in the shared folder and read again; an open `scratch` drops them."""
    path = f"{shared_folder(df.sparkSession)}/corrobix/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
