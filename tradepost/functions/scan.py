"""Running totals and positions in arrival order.

Keys of ordinary size take one window. When some key has more rows than one window should take, and for tables numbered as a
whole, rows are dealt to range partitions by key and arrival: rows are added up inside (key, partition), and the totals of the
partitions, which are few, are accumulated and added back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .durable import cut
from .limits import LIMITS


def running_total(df: DataFrame, keys: list[str], seq: str, value: Column, name: str) -> DataFrame:
    """``df`` with column ``name``: the sum of ``value`` over the key's rows up to this one. Looks for the largest key first."""
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    upto = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    if most <= LIMITS.window_rows:
        return df.withColumn(name, F.sum(value).over(upto))
    # The bounds come from a sample: write the split out so that every later use sees the same one.
    rows = cut(df.withColumn("_value", value).repartitionByRange(*keys, seq).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_part").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn(name, F.sum("_value").over(inside))
    kind = local.schema[name].dataType
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_part")
        .agg(F.sum("_value").alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)).cast(kind))
        .drop("_total")
    )
    return (
        local.join(offsets, [*keys, "_part"])
        .withColumn(name, (F.col(name) + F.col("_before")).cast(kind))
        .drop("_part", "_value", "_before")
    )


def position(df: DataFrame, keys: list[str], seq: str, name: str = "position") -> DataFrame:
    """``df`` with column ``name``: 1 for the first row of the key, 2 for the next, and so on."""
    return running_total(df, keys, seq, F.lit(1).cast("bigint"), name)


def numbered(df: DataFrame, seq: str, name: str = "position") -> DataFrame:
    """The whole table numbered from 1 in the order of ``seq``: a row's place inside its range partition plus the rows of the
    partitions before. What is accumulated has one row per partition."""
    line = cut(df.repartitionByRange(seq).sortWithinPartitions(seq).withColumn("_at", F.monotonically_increasing_id()))
    line = line.withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = line.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")).select(
        "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift")
    )
    return line.join(F.broadcast(starts), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def new_ids(df: DataFrame, existing: DataFrame, id_column: str, seq: str) -> DataFrame:
    """``df`` with ``id_column``: numbers after the largest existing id, in arrival order."""
    last = existing.agg(F.coalesce(F.max(id_column), F.lit(0)))
    return numbered(df, seq, "_position").withColumn(id_column, last.scalar() + F.col("_position")).drop("_position")
