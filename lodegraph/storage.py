"""The folder that driver and executors share, and frames cut from their lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

#: Paths written below the shared folder, with their file systems.
_WRITTEN: list[tuple] = []


@atexit.register
def _drop_written() -> None:
    for store, path in _WRITTEN:
        with suppress(Exception):  # the gateway may be gone
            store.delete(path, True)


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where the session sets none and runs on one
    machine, as in tests, a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = getattr(spark.sparkContext, "_lodegraph_root", None)
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        known = spark.sparkContext._lodegraph_root = "file://" + tempfile.mkdtemp(prefix="lodegraph-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def checkpointed(df: DataFrame) -> DataFrame:
    shared_root(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """A scan that gives costly work to few tasks (a small table in one file),
    dealt to all; larger ones stay as they are."""
    most = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(most) if df.rdd.getNumPartitions() < most else df


def stored(df: DataFrame, what: str) -> DataFrame:
    """Written to the shared folder and read again; it goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/lodegraph-{what}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    _WRITTEN.append((at.getFileSystem(spark._jsc.hadoopConfiguration()), at))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
