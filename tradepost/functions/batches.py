"""Tables that grow batch by batch: a batch is a partition of a parquet table, so a batch that is repeated after a failure
replaces what it wrote before. Readers add the batches up, or take the newest row per key."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def put_batch(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def stored(spark: SparkSession, path: str, columns: str | T.StructType) -> DataFrame:
    """Rows that batches have written, with their ``batch``; none if nothing is written yet."""
    schema = T.StructType.fromDDL(columns) if isinstance(columns, str) else columns
    schema = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def newest(rows: DataFrame, *keys: str) -> DataFrame:
    """The row of the newest batch for each key."""
    rest = [n for n in rows.columns if n not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*keys, "_row.*")
