"""Values that follow from other rows: list and order totals, product ratings, settled orders, notices
and the history of paid orders."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import mean, money_sum
from ..functions.joins import keyed_join
from ..functions.scan import numbered, position, running_total
from ..sources.schema import MONEY, MONEY_SUM, RATE

Frames = Mapping[str, DataFrame]


def item_totals(items: DataFrame, product: DataFrame, key: str) -> DataFrame:
    """Per ``key``: the sum of quantity times current price."""
    prices = product.select("product_id", "price")
    return (
        keyed_join(items.select(key, "product_id", "quantity"), prices, "product_id")
        .groupBy(key)
        .agg(money_sum(F.col("quantity") * F.col("price")).alias("total"))
    )


def favorite_totals(tables: Frames) -> DataFrame:
    """Favorite lists with their totals; an empty list has 0."""
    totals = item_totals(tables["favorite_list_items"], tables["product"], "favorite_id")
    return (
        tables["favorite_list"]
        .join(totals, "favorite_id", "left")
        .withColumn("total_price", F.coalesce("total", F.lit(0)).cast(MONEY_SUM))
        .drop("total")
    )


def order_totals(tables: Frames, touched: DataFrame | None = None) -> DataFrame:
    """Orders with their totals recomputed, which forgets discounts; an order without items keeps its
    stored total. ``touched`` (order_id) limits the work to some orders, the rest are kept."""
    items = tables["order_items"]
    if touched is not None:
        items = keyed_join(items, touched.select("order_id").distinct(), "order_id", "left_semi")
    totals = item_totals(items, tables["product"], "order_id")
    return (
        tables["order"]
        .join(totals, "order_id", "left")
        .withColumn("total_price", F.coalesce("total", "total_price").cast(MONEY_SUM))
        .drop("total")
    )


def check_order_addresses(orders: DataFrame, address: DataFrame) -> DataFrame:
    """``orders`` plus ``accepted``: does the address belong to the customer?"""
    owners = address.select("address_id", F.col("customer_id").alias("_owner"))
    return (
        keyed_join(orders, owners, "address_id", "left")
        .withColumn("accepted", F.coalesce(F.col("_owner") == F.col("customer_id"), F.lit(False)))
        .drop("_owner")
    )


def payment_progress(tables: Frames) -> DataFrame:
    """Payments with the running paid sum of their order in arrival order (payment id). A payment of an order that is not known (yet)
    is kept, without a total, and covers nothing."""
    orders = tables["order"].select("order_id", "total_price")
    # The largest order is looked for among the payments alone, before anything is joined.
    payments = tables["payment"].select("payment_id", "order_id", "amount")
    running = running_total(payments, ["order_id"], "payment_id", F.col("amount").cast(MONEY_SUM), "paid_so_far")
    return keyed_join(running, orders, "order_id", "left").select(
        "payment_id",
        "order_id",
        "amount",
        "total_price",
        F.col("paid_so_far").cast(MONEY_SUM).alias("paid_so_far"),
        F.coalesce(F.col("paid_so_far") >= F.col("total_price"), F.lit(False)).alias("covers"),
    )


def payment_settlement(tables: Frames) -> DataFrame:
    """Per order with payments, without wallets: the payment that first covers the total, what it left
    over, and all that was paid. An order that is not known has no total and is not paid."""
    reached = F.when(F.col("covers"), F.struct("payment_id", "paid_so_far"))
    return (
        payment_progress(tables)
        .groupBy("order_id", "total_price")
        .agg(money_sum(F.col("amount")).alias("total_paid"), F.min(reached).alias("_hit"))
        .select(
            "order_id",
            "total_price",
            "total_paid",
            F.col("_hit").isNotNull().alias("paid"),
            F.col("_hit.payment_id").alias("settled_by"),
            (F.col("_hit.paid_so_far") - F.col("total_price")).cast(MONEY_SUM).alias("excess"),
        )
    )


def product_ratings(tables: Frames, touched: DataFrame | None = None) -> DataFrame:
    """Products with the mean of their ratings, NULL when reviewed but never rated. Products that were
    never reviewed keep their rating; ``touched`` (product_id) names those whose reviews changed or
    went away."""
    rated = tables["review"].groupBy("product_id").agg(
        F.sum("rating").alias("_sum"), F.count("rating").alias("_n")
    )
    if touched is not None:
        known = touched.select("product_id").distinct()
        rated = known.join(rated, "product_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    fresh = rated.select("product_id", mean("_sum", "_n").cast(RATE).alias("_mean"), F.lit(True).alias("_hit"))
    return (
        tables["product"]
        .join(fresh, "product_id", "left")
        .withColumn("rating", F.when(F.col("_hit"), F.col("_mean")).otherwise(F.col("rating")))
        .drop("_mean", "_hit")
    )


def notice_columns() -> tuple[Column, Column]:
    """Kind and text of the notice for a review."""
    rating, comment = F.col("rating"), F.col("comment")
    kind = (
        F.when(rating.isNull() & comment.isNotNull(), "comment")
        .when(comment.isNull(), "rating")
        .otherwise("both")
    )
    shown = F.coalesce(rating.cast("string"), F.lit("<NULL>"))
    who = [F.col("product_id").cast("string"), F.col("customer_id").cast("string")]
    # The three message texts.
    text = (
        F.when(
            kind == "comment",
            F.format_string("new review added for product %s by customer :%s comment :%s ", *who, comment),
        )
        .when(
            kind == "rating",
            F.format_string("new review added for product %s by customer :%s rating :%s ", *who, shown),
        )
        .otherwise(
            F.format_string(
                "new review added for product %s by customer :%s rating :%s comment :%s ", *who, shown, comment
            )
        )
    )
    return kind, text


def review_notifications(review: DataFrame) -> DataFrame:
    kind, text = notice_columns()
    return review.select("review_id", "product_id", "customer_id", kind.alias("kind"), text.alias("message"))


def paid_orders(orders: DataFrame) -> DataFrame:
    return orders.filter("status").select("order_id")


def order_history(
    tables: Frames,
    paid: DataFrame | None = None,
    dedupe: bool = False,
    as_of: str | None = None,
    last_id: int = 0,
    page_rows: int | None = None,
) -> DataFrame:
    """Rows for the order history table (log_id, customer_id, order_id, order_details, logged_at), one per paid transition. The
    document holds the order's date, total, status and items at current prices; an order without items has NULL items.

    ``paid`` (order_id) lists the transitions, by default one for each paid order; an order that is set
    to paid again is logged again unless ``dedupe``. ``log_id`` goes on after ``last_id`` in the order of order ids,
    ``logged_at`` is ``as_of`` or now. Only with ``page_rows`` is the document of a transition split: there is then one row for
    each ``page`` of so many items, all with the same ``log_id``.
    """
    events = paid_orders(tables["order"]) if paid is None else paid.select("order_id")
    if dedupe:
        events = events.distinct()
    orders = tables["order"].select("order_id", "customer_id", "order_date", "total_price", "status")
    once = events if paid is None or dedupe else events.distinct()
    logged = keyed_join(orders, once, "order_id", "left_semi")
    items = keyed_join(
        tables["order_items"].select("order_id", "product_id", "quantity"),
        logged.select("order_id"),
        "order_id",
        "left_semi",
    )
    priced = keyed_join(items, tables["product"].select("product_id", "price"), "product_id")
    entry = F.struct("product_id", F.col("quantity").cast("int").alias("quantity"), F.col("price").cast(MONEY).alias("price"))
    keys = ["order_id"]
    if page_rows:
        priced, keys = paged(priced, page_rows), ["order_id", "page"]
    lists = priced.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("items"))
    moment = F.localtimestamp() if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    transitions = numbered(events, "order_id", "_nth")
    return (
        keyed_join(transitions, logged, "order_id")
        .join(lists, "order_id", "left")
        .select(
            (F.col("_nth") + last_id).alias("log_id"),
            "customer_id",
            "order_id",
            *([F.coalesce("page", F.lit(0)).alias("page")] if page_rows else []),
            F.struct("order_date", "total_price", F.lit(True).alias("status"), "items").alias("order_details"),
            moment.alias("logged_at"),
        )
    )


def paged(items: DataFrame, page_rows: int) -> DataFrame:
    """``items`` of orders with the ``page`` each falls on, by product id."""
    page = F.floor((F.col("position") - 1) / page_rows).cast("int")
    return position(items, ["order_id"], "product_id").withColumn("page", page)


def history_json(log: DataFrame) -> DataFrame:
    """The log with its documents as JSON text; members without a value are written as null."""
    return log.withColumn("order_details", F.to_json("order_details", {"ignoreNullFields": "false"}))
