"""Tables that a job writes for itself, and row numbers to find a row again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import work_folder

ROW = "_tp_row"


class Scratch:
    """A folder of the job in the shared folder that ``spark.checkpoint.dir`` names. ``cut`` writes a table
    there and reads it back, so that later steps see the same rows after an executor is lost and nothing is
    computed twice. Leaving a ``with`` block deletes the folder."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.path = work_folder(spark, purpose)
        self._n = 0

    def cut(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with a number per row, so a decision about a row finds it again even when ids are missing or repeated.

    Numbers depend on how files are split, and so on the cores there are when a job is planned: they hold for one job only.
    What several jobs need has to be written with its numbers by one of them (``Scratch.cut``) and read from there."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


def column(df: DataFrame, name: str):
    """Column ``name`` even when it holds dots."""
    return df["`" + name.replace("`", "``") + "`"]
