"""What the training-data operators share: the shared folder, files, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDERS: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session sets none and runs on a single machine, as in tests,
    is a temporary folder made and set as checkpoint folder.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = getattr(spark.sparkContext, "_lodegraph_shared", None)
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="lodegraph-")
        spark.sparkContext._lodegraph_shared = known
        spark.sparkContext.setCheckpointDir(known + "/checkpoints")
        _FOLDERS.append(known)
    return known


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the shared root; it goes when the driver ends."""
    path = f"{shared_root(spark)}/lodegraph-{what}-{uuid.uuid4().hex}"
    _FOLDERS.append(path)
    return path


def file_system(uri: str):
    """(pyarrow file system, path in it) of a URI or of an absolute path. Hadoop's
    names of S3 are those of Arrow's; stores that Arrow can't open are an error."""
    from pyarrow import fs

    for hadoop in ("s3a://", "s3n://"):
        uri = uri.replace(hadoop, "s3://", 1) if uri.startswith(hadoop) else uri
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def publish(uri: str, write) -> None:
    """Write a file whole or not at all: ``write(stream)`` fills a file of its
    own, which then takes the final name, so that lost or doubled attempts of a
    task leave no half-written file."""
    store, path = file_system(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with store.open_output_stream(attempt) as out:
            write(out)
        store.move(attempt, path)
    except BaseException:
        with suppress(Exception):
            store.delete_file(attempt)
        raise


def drop_folder(uri: str) -> None:
    with suppress(Exception):
        store, path = file_system(uri)
        store.delete_dir(path)


@atexit.register
def _drop_folders() -> None:
    for uri in _FOLDERS:
        drop_folder(uri)


def stored(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and a lost
    executor costs nothing."""
    path = work_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by exact name, whatever else the table holds."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def heavy_keys(counted: DataFrame, key: str, part: int = 1000) -> list:
    """Keys of ``counted(key, n)`` with more than one row in ``part``, so fewer
    than ``part`` keys, however large the table."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    return [r[0] for r in counted.where((F.col("n") > 1) & (F.col("n") * part > F.lit(total))).select(key).collect()]


def join_salted(left: DataFrame, right: DataFrame, key: str, heavy: list, salts: int = 64) -> DataFrame:
    """``left.join(right, key)``, where ``right`` has a row a key: rows of
    ``left`` under heavy keys are dealt to ``salts`` copies of that row."""
    if not heavy:
        return left.join(right, key)
    hot = F.col(key).isin(heavy)
    dealt = left.withColumn("_salt", F.when(hot, F.monotonically_increasing_id() % salts).otherwise(F.lit(0)).cast("int"))
    copied = right.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)``, root being
    the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., "Connected
    Components in MapReduce and Beyond", 2014): each step points neighbours at
    the smallest one, rows never exceed the edges, and of a node's neighbours
    only the least is ever aggregated; the edges of a hub are joined by its id,
    which adaptive execution splits where they are many.
    """
    shared_root(spark)  # sets a checkpoint folder where there is none
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    seen = None
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pointed = large.join(low, "u")
        small = pointed.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = tuple(e.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
