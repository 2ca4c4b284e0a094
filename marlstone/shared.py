"""Tables written to the folder that all executors share, to cut lineage between rounds of a loop; memory of workers."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only on a local master that sets none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        had = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = had.get() if had.isDefined() else "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(base)
    return base if ":/" in base else f"file://{base}"


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """The frame, written once and read back; its files go when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marlstone/{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def split(df: DataFrame, test: Column, what: str) -> tuple[DataFrame, DataFrame]:
    """The rows that don't meet the test and those that do, both written in one pass and read back, so that either can be removed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marlstone/{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    df.withColumn("_side", F.coalesce(test, F.lit(False)).cast("int")).write.partitionBy("_side").parquet(path)
    folders = [spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_side={side}") for side in (0, 1)]
    for folder in folders:  # of no rows there would be none
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return tuple(spark.read.schema(df.schema).parquet(folder.toString()) for folder in folders)


def remove(df: DataFrame) -> None:
    """Deletes the files of a frame that `split` has read back, before the driver ends: what needed it has been written."""
    for file in df.inputFiles():
        _remove(df.sparkSession, file)


def release() -> None:
    """Gives memory that a worker no longer uses back to the machine: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)
