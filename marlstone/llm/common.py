"""Shared-folder tables, column helpers and connected components for the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as a URI: spark.checkpoint.dir, else the one set on the context.

    Only where neither is set, as in tests on one machine, is a temporary folder made."""
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not base:
        had = spark.sparkContext._jsc.sc().getCheckpointDir()
        if had.isDefined():
            base = had.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="marlstone-")
            spark.sparkContext.setCheckpointDir(base)
    return base if "://" in base or base.startswith("file:") else f"file://{base}"


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/marlstone/{what}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path on whatever file system it is."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # the session has ended; the cluster's folder has its own clean-up
        return


def saved(df: DataFrame, what: str, options: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """Cuts lineage: the frame written once to the shared folder, with `options` of the writer, and read back, and its path."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.option("compression", "zstd").options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release() -> None:
    """Gives memory that a worker no longer uses back to the machine: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that releases memory when its task ends."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def texts(docs: DataFrame) -> DataFrame:
    """Just (doc_id BIGINT, text STRING) of a table that may have any other columns; rows without an id or a text go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")


def fresh(name: str, *frames: DataFrame) -> str:
    """`name`, with underscores before it until no column of the frames is called so, in whatever case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of undirected `edges` (a BIGINT, b BIGINT); the root is the least node connected to it.

    Alternating large-star and small-star steps; every round is written to the shared folder, since
    lineage would double with each.  Ends when a round changes no edge.  An empty table gives an empty one."""
    spark = edges.sparkSession
    near, path = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = Window.partitionBy("a")
        large = both.withColumn("m", F.least(F.col("a"), F.min("b").over(low))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        least = large.withColumn("m", F.min("b").over(low))
        small = least.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after, new = saved(small, "edges")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove(spark, path)
        near, path = after, new
        if now == before:
            return near.select(F.col("a").alias("node"), F.col("b").alias("root")).union(near.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
