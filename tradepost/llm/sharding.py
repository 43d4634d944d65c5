"""Contiguous shards of nearly equal bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

#: Rows of one block: the running sum inside a block is one window group.
BLOCK = 4096
_LOW = (1 << 33) - 1


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus 1; a missing text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def assign_shards(
    rows: DataFrame, order: str, size: Column, shards: int, payload: dict[str, Column] | None = None
) -> DataFrame:
    """One row per row of ``rows``: the column ``order``, ``size``, the columns of ``payload``, ``shard`` and ``slot``.

    Rows are laid in a line by ``order`` and the line is cut where the sum of sizes passes equal targets; a row
    belongs to the shard that holds its middle, so a shard misses its target by less than two rows.
    ``slot`` numbers the rows of a shard from 0.

    The line is sorted by range partitions. Sums of blocks, then of partitions, are accumulated, and only the rows
    of one block are summed together. Missing values of ``order`` come first, rows with equal
    ones follow in the order they are read. An empty table gives no rows. Columns not asked for are left out,
    so their names don't matter.
    """
    spark = rows.sparkSession
    payload = payload or {}
    keep = Scratch(spark, "shards")
    with Scratch(spark, "shard-line") as temp:
        slim = temp.cut(
            rows.select(
                F.col(order).alias("_id"),
                size.alias("_size"),
                F.monotonically_increasing_id().alias("_read"),
                *(c.alias(f"_p_{n}") for n, c in payload.items()),
            )
        )
        line = temp.cut(
            slim.repartitionByRange("_id", "_read")
            .sortWithinPartitions("_id", "_read")
            .withColumn("_at", F.monotonically_increasing_id())
            .withColumn("_part", F.shiftright("_at", 33))
            .withColumn("_n", F.col("_at").bitwiseAND(F.lit(_LOW)))
            .withColumn("_block", F.floor(F.col("_n") / BLOCK))
            .drop("_at", "_read")
        )
        blocks = line.groupBy("_part", "_block").agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
        parts = blocks.groupBy("_part").agg(F.sum("_bytes").alias("_bytes"), F.sum("_rows").alias("_rows"))
        # One row per range partition, so this window without a key is small.
        ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        parts = parts.select(
            "_part",
            F.coalesce(F.sum("_bytes").over(ahead), F.lit(0)).alias("_part_bytes"),
            F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_part_rows"),
            F.sum("_bytes").over(every).alias("_total"),
        )
        inside = Window.partitionBy("_part").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        starts = (
            blocks.withColumn("_block_bytes", F.coalesce(F.sum("_bytes").over(inside), F.lit(0)))
            .join(F.broadcast(parts), "_part")
            .select("_part", "_block", (F.col("_part_bytes") + F.col("_block_bytes")).alias("_start"), "_part_rows", "_total")
        )
        within = Window.partitionBy("_part", "_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
        middle = "2 * (_start + _run - _size) + _size"
        placed = keep.cut(
            line.withColumn("_run", F.sum("_size").over(within))
            .join(starts, ["_part", "_block"])
            .withColumn("shard", F.expr(f"least({shards - 1}, ({middle}) * {shards} div (2 * _total))").cast("int"))
            .withColumn("_place", F.col("_part_rows") + F.col("_n"))
            .select("_id", "_size", "shard", "_place", *(f"_p_{n}" for n in payload))
        )
    first = placed.groupBy("shard").agg(F.min("_place").alias("_first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("_id").alias(order),
        F.col("_size").alias("size"),
        *(F.col(f"_p_{n}").alias(n) for n in payload),
        "shard",
        (F.col("_place") - F.col("_first")).alias("slot"),
    )
