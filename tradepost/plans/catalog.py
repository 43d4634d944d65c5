"""The named views and stored summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import stored
from ..functions.columns import month_of
from ..functions.durable import cut
from ..functions.joins import keyed_join, reduced
from ..operators import customers, reviews, sales
from ..sources.reader import Tables

Frames = Mapping[str, DataFrame]

# View names.
VIEWS: dict[str, Callable[[Frames], DataFrame]] = {
    "payment_details": customers.payment_details,
    "users_favorites": reviews.users_favorites,
    "user_orders": customers.user_orders,
    "popular_products": sales.popular_products,
    "total_spending_per_user": customers.total_spending_per_user,
}


def register_views(tables: Frames) -> list[str]:
    """Make the views queryable by name in the session."""
    for name, build in VIEWS.items():
        build(tables).createOrReplaceTempView(name)
    return list(VIEWS)


#: Summaries by key are kept in so many partitions.
BUCKETS = 64


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("string")


def _signed(changes: DataFrame) -> DataFrame:
    return changes if "sign" in changes.columns else changes.withColumn("sign", F.lit(1))


def _unit_changes(items: DataFrame, *keys: str) -> DataFrame:
    units = F.sum(F.col("sign") * F.col("quantity")).cast("bigint").alias("units")
    return items.groupBy("product_id", *keys).agg(units, F.sum("sign").cast("bigint").alias("n_items"))


def _product_units(changes: Frames) -> DataFrame:
    return _unit_changes(_signed(changes["order_items"]))


def _month_units(changes: Frames) -> DataFrame:
    orders = changes["order"].select("order_id", month_of("order_date").alias("sales_month"))
    return _unit_changes(keyed_join(_signed(changes["order_items"]), orders, "order_id"), "sales_month")


def _review_counts(changes: Frames) -> DataFrame:
    sign = F.col("sign")
    return _signed(changes["review"]).groupBy("customer_id").agg(
        F.sum(sign).cast("bigint").alias("n_reviews"),
        F.sum(F.when(F.col("rating").isNotNull(), sign).otherwise(0)).cast("bigint").alias("n_rated"),
        F.coalesce(F.sum(sign * F.col("rating")), F.lit(0)).cast("bigint").alias("rating_sum"),
    )


@dataclass(frozen=True)
class Summary:
    """A stored summary: ``build`` makes it from the tables.

    One that can be refreshed has counts that add up over changes: ``changed`` makes them from signed rows, ``counts`` are their columns by
    ``keys``, and those with no row left (``alive``) are gone. Counts and the summary are kept in partitions named by ``part``.
    ``finish`` makes the rows of some partitions from their counts and the current tables; ``owner`` is the table whose rows a
    summary by key lists, and ``moved`` the column by which changed rows of a table touch counts."""

    build: Callable[[Frames], DataFrame]
    changed: Callable[[Frames], DataFrame] | None = None
    keys: str = ""
    counts: str = ""
    alive: str = "n_items"
    part: Callable[[], Column] = lambda: F.lit("all")
    finish: Callable[[DataFrame, Frames], DataFrame] | None = None
    owner: str | None = None
    moved: str = "product_id"
    whole: bool = False  # one partition, made from all counts


def _monthly(counts: DataFrame, t: Frames) -> DataFrame:
    report = sales.monthly_report_from_units(counts, t["product"], t["category"])
    return report.withColumn("part", F.date_format("sales_month", "yyyy-MM"))


# Summary names.
SUMMARIES: dict[str, Summary] = {
    "reviews": Summary(
        reviews.customer_reviews,
        _review_counts,
        "customer_id bigint",
        "n_reviews bigint, n_rated bigint, rating_sum bigint",
        "n_reviews",
        lambda: _bucket("customer_id"),
        lambda counts, t: reviews.customer_reviews_from_parts(t["customer"], counts).withColumn("part", _bucket("customer_id")),
        "customer",
        "customer_id",
    ),
    "product_summary": Summary(
        sales.product_summary,
        _product_units,
        "product_id bigint",
        "units bigint, n_items bigint",
        part=lambda: _bucket("product_id"),
        finish=lambda counts, t: sales.product_summary_from_units(counts, t["product"]).withColumn("part", _bucket("product_id")),
        owner="product",
    ),
    "discount_summary": Summary(sales.discount_summary),
    "sales_by_category": Summary(
        sales.sales_by_category,
        _product_units,
        "product_id bigint",
        "units bigint, n_items bigint",
        finish=lambda counts, t: sales.sales_by_category_from_units(counts, t["product"], t["category"]).withColumn("part", F.lit("all")),
        whole=True,
    ),
    "monthly_report": Summary(
        sales.monthly_report,
        _month_units,
        "product_id bigint, sales_month timestamp_ntz",
        "units bigint, n_items bigint",
        part=lambda: F.date_format("sales_month", "yyyy-MM"),
        finish=_monthly,
    ),
}


def read_summary(tables: Tables, name: str, path: str) -> DataFrame:
    """A stored summary, also one without rows."""
    schema = SUMMARIES[name].build(tables).schema
    return stored(tables.spark, f"{path}/{name}", schema.add("part", "string")).drop("part", "batch").select(*schema.names[:-1])


def write_summaries(tables: Tables, path: str, names: list[str] | None = None) -> None:
    """Store summaries of all rows below ``path``, in place of what is there."""
    for name in names or SUMMARIES:
        refresh_summary(name, 0, tables, tables, path)


def refresh_summary(name: str, batch: int, changes: Frames, tables: Tables, path: str, moved: DataFrame | None = None) -> DataFrame:
    """Bring a stored summary up to date after a batch of changes and return it.

    ``changes`` holds changed items (and the orders they belong to) or reviews, with ``sign`` +1 for a row that appears and -1 for one
    that goes away; an update is one of each, and rows without a sign appear. ``moved`` has the keys of products or customers that are
    new, gone, renamed or priced or sorted anew. ``tables`` are the tables after the changes; of items and reviews only the
    changed rows are read, for all others their counts are there.

    A batch writes its counts into a folder of its own, so a repeated batch changes nothing. Only partitions that the batch touches are
    made again and overwritten; the files of others stay as they are. Batch 0 begins anew.
    """
    spark, summary = tables.spark, SUMMARIES[name]
    if summary.changed is None:
        _overwrite(cut(summary.build(tables).withColumn("part", F.lit("all"))), ["all"], f"{path}/{name}")
        return read_summary(tables, name, path)
    parts = f"{path}/counts/{name}"
    if batch == 0:
        _delete(spark, parts)
        _delete(spark, f"{path}/{name}")
    changed = cut(summary.changed(changes).withColumn("part", summary.part()))
    # One shuffle by partition, so that each is a few files.
    writer = changed.repartition("part").write.mode("overwrite").partitionBy("part")
    writer.parquet(f"{parts}/batch={batch}")
    counts = stored(spark, parts, f"{summary.keys}, {summary.counts}, part string").drop("batch")
    touched = changed.select("part")
    if moved is not None:
        keys = moved.select(summary.moved).distinct()
        of_moved = keys.select(_bucket(summary.moved).alias("part")) if summary.owner else reduced(counts, keys, summary.moved).select("part")
        touched = touched.unionByName(of_moved)
    if batch == 0 and summary.owner:  # owners without any count are listed too
        touched = touched.unionByName(tables[summary.owner].select(_bucket(summary.moved).alias("part")))
    names = [r["part"] for r in touched.distinct().collect()]  # months, or at most BUCKETS
    if names:
        keys = [c.split()[0] for c in summary.keys.split(", ")]
        some = counts if summary.whole else counts.filter(F.col("part").isin(names))
        sums = [F.sum(c.split()[0]).cast("bigint").alias(c.split()[0]) for c in summary.counts.split(", ")]
        alive = some.groupBy(*keys).agg(*sums).filter(F.col(summary.alive) != 0)
        now = tables
        if summary.owner:
            owners = tables[summary.owner]
            now = tables.replace(**{summary.owner: owners.filter(_bucket(summary.moved).isin(names))})
        _overwrite(cut(summary.finish(alive, now).filter(F.col("part").isin(names))), names, f"{path}/{name}")
    return read_summary(tables, name, path)


def _overwrite(rows: DataFrame, parts: list[str], path: str) -> None:
    """Put ``rows`` in place of the named partitions; one without rows goes."""
    rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    filled = {r["part"] for r in rows.select("part").distinct().collect()}
    for part in set(parts) - filled:
        _delete(rows.sparkSession, f"{path}/part={part}")


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
