"""Shared folders that outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. A machine-local one is made only in local mode,
    where the driver is the only machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="tradepost-")
    return _local[context.applicationId]


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for one use. It stays until ``release`` or until whoever owns the shared folder
    clears it."""
    path = f"{shared_folder(spark)}/tradepost/{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written out once and read back: later uses see the same rows even when executors are
    lost and even when ``df`` depends on sampled partition bounds. Unlike a checkpoint, the rows are
    computed only once, and the size of the result is known to later joins."""
    spark = df.sparkSession
    path = work_folder(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what this application has written with ``cut`` and ``work_folder``. Results that are still
    to be computed from it must have been written elsewhere before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(
        f"{shared_folder(spark)}/tradepost/{spark.sparkContext.applicationId}"
    )
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
