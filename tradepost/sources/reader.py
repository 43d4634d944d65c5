"""Shop tables as lazily read DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from .schema import TABLES


class Tables(Mapping):
    """Name -> DataFrame, each built on first use, so a job only reads what it names."""

    def __init__(self, spark: SparkSession, builders: Mapping[str, Callable[[], DataFrame]]):
        self.spark = spark
        self._builders = dict(builders)
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)

    def replace(self, **frames: DataFrame) -> "Tables":
        """The same tables with some of them replaced, as after a batch of changes."""
        out = Tables(self.spark, self._builders)
        out._built = dict(self._built)
        for name, frame in frames.items():
            out._builders[name] = lambda frame=frame: frame
            out._built[name] = frame
        return out


def load(spark: SparkSession, folder: str) -> Tables:
    """The shop tables under ``folder``, one parquet table per name; the schema is declared, so
    no file is opened before a job runs and a stored password column is never read."""

    def reader(name: str) -> Callable[[], DataFrame]:
        schema = TABLES[name].schema
        return lambda: spark.read.schema(schema).parquet(f"{folder}/{name}")

    return Tables(spark, {name: reader(name) for name in TABLES})
