"""Starting and finishing Structured Streaming jobs.

What a micro-batch adds or changes is written with ``functions.batches``, so a repeated batch replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

OnBatch = Callable[[DataFrame, int], None]


def file_stream(
    spark: SparkSession, folder: str, schema, files: str = "*.parquet", files_per_batch: int | None = 1000
) -> DataFrame:
    """Rows of the parquet files that appear in ``folder``, oldest file first; without ``files_per_batch`` a batch takes all there are."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def start(changes: DataFrame, on_batch: OnBatch, checkpoint: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Run ``on_batch`` on each micro-batch: for as long as there is input (the default), or every
    ``every`` (such as "1 minute") until stopped."""
    writer = changes.writeStream.foreachBatch(on_batch).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def append_to(rows: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a stream without state to a parquet table."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start(path)


def finish(query: StreamingQuery) -> None:
    """Wait for the end of the input; an error inside a batch is raised here."""
    query.awaitTermination()
