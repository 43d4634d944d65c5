"""Shop tables stored so that the frequent joins need no shuffle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from .reader import Tables
from .schema import TABLES

# Tables that meet on the order are bucketed by it, those that meet on the customer by that.
BUCKETED_BY = {
    "order": "order_id",
    "order_items": "order_id",
    "payment": "order_id",
    "discount_code": "order_id",
    "gift_card": "order_id",
    "order_history_log": "order_id",
    "customer": "customer_id",
    "address": "customer_id",
    "favorite_list": "customer_id",
}


def save_bucketed(tables: Mapping[str, DataFrame], folder: str, prefix: str, buckets: int) -> None:
    """Write ``tables`` as catalog tables ``prefix`` + name under ``folder``. Rows are shuffled by the
    bucket key first, so that each bucket is one file, sorted by the key."""
    for name, df in tables.items():
        key = BUCKETED_BY.get(name)
        ordered = df.repartition(buckets, key) if key else df
        writer = ordered.write.mode("overwrite").option("path", f"{folder}/{name}")
        if key:
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(f"`{prefix}{name}`")


def load_bucketed(spark: SparkSession, prefix: str) -> Tables:
    """The tables written by ``save_bucketed``."""
    present = {t.name for t in spark.catalog.listTables()}
    return Tables(
        spark,
        {n: (lambda n=n: spark.table(f"`{prefix}{n}`")) for n in TABLES if f"{prefix}{n}" in present},
    )
