"""Groups of nodes that are linked directly or over others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import cut
from .joins import keyed_join
from .limits import LIMITS


def linked_groups(links: DataFrame) -> DataFrame:
    """(node, group) for every node of ``links`` (a, b): group is the smallest node reachable.

    Each round gives a node the smallest group among itself and its neighbours and then jumps to
    that group's own group, so long chains shrink by half or better per round. A node with very many
    links is reduced by a map-side minimum. Few links are stored in few files, however many shuffle partitions
    there are.
    """
    spark = links.sparkSession
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    parts = max(spark.sparkContext.defaultParallelism, -(-both.count() // LIMITS.stored_links))
    few = parts < int(spark.conf.get("spark.sql.shuffle.partitions"))

    def stored(df: DataFrame) -> DataFrame:
        return cut(df.coalesce(parts) if few else df)

    smallest = both.groupBy("a").agg(F.min("b").alias("b"))
    groups = stored(smallest.select(F.col("a").alias("node"), F.least("a", "b").alias("group")))
    while True:
        nearby = (
            keyed_join(both, groups.select(F.col("node").alias("b"), "group"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("group").alias("_near"))
        )
        closer = stored(
            groups.join(nearby, "node").select("node", "group", F.least("group", "_near").alias("_next"))
        )
        far = closer.select(F.col("node").alias("_next"), F.col("_next").alias("_jump"))
        jumped = stored(
            keyed_join(closer, far, "_next").select("node", "group", F.least("_next", "_jump").alias("_new"))
        )
        if jumped.filter(F.col("_new") != F.col("group")).isEmpty():
            return groups
        groups = jumped.select("node", F.col("_new").alias("group"))
