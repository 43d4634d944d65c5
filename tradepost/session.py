"""Session settings the jobs expect."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Zone-less times need one fixed zone; AQE splits skewed partitions and merges small ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Shuffled keys are packed some twenty times smaller than a task holds them, so merged partitions stay small.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.ansi.enabled": "true",
    # Stateful processors keep their entries in this store.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    if not spark.sparkContext.master.startswith("local"):
        ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python steps import it. Done once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="tradepost-"), "tradepost")
        root, name = os.path.split(package)
        context.addPyFile(shutil.make_archive(target, "zip", root, name))
        _shipped.add(context.applicationId)


def local_session(cores: str = "*", shuffle_partitions: int = 8, name: str = "tradepost") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # Noting the caller's line for every column takes longer than building the plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
