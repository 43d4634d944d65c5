"""Joins of a large table to a side that has one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import cut
from .limits import LIMITS


def keyed_join(fact: DataFrame, side: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join ``fact`` to ``side``, which has one row per value of ``on``; ``how`` is inner, left, left_semi or left_anti.

    One join, whatever the data: Spark broadcasts a side whose size it knows to be small, and the adaptive skew join, which
    ``session.configure`` switches on, splits the rows of ``fact`` that share a heavy key.
    """
    return fact.join(side, on, how)


def reduced(side: DataFrame, rows: DataFrame, on: str) -> DataFrame:
    """The rows of a large ``side`` whose key occurs in a small batch ``rows``. The keys are sent everywhere if a count finds few
    of them, so that the side is filtered where it is read and not shuffled."""
    keys = cut(rows.select(on).distinct())
    few = keys.count() <= LIMITS.broadcast_keys
    return side.join(F.broadcast(keys) if few else keys, on, "left_semi")


def first_per_key(requests: DataFrame, *keys: str, seq: str = "seq") -> DataFrame:
    """``requests`` with a flag ``is_first``: the earliest of its key. The winners come from a map-side
    minimum and are matched on key and ``seq`` together, which spreads a key with many requests."""
    winners = requests.groupBy(*keys).agg(F.min(seq).alias(seq)).withColumn("is_first", F.lit(True))
    return requests.join(winners, [*keys, seq], "left").withColumn(
        "is_first", F.coalesce("is_first", F.lit(False))
    )

