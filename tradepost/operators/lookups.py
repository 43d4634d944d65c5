"""Lookups for many keys at once. A key that is not found gives no row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import keyed_join
from .derive import paged

Frames = Mapping[str, DataFrame]


def matching(df: DataFrame, column: str, keys) -> DataFrame:
    """Rows whose ``column`` is among ``keys``: a list, a DataFrame with that column, or None for all."""
    if keys is None:
        return df
    if isinstance(keys, DataFrame):
        return keyed_join(df, keys.select(column).distinct(), column, "left_semi")
    return df.filter(F.col(column).isin(list(keys)))


def customer_by_username(tables: Frames, usernames) -> DataFrame:
    return matching(tables["customer"], "username", usernames).select(
        "customer_id", "first_name", "last_name", "username", "wallet_balance"
    )


def addresses_of_customer(tables: Frames, customer_ids) -> DataFrame:
    return matching(tables["address"], "customer_id", customer_ids).drop("customer_id")


def order_products(tables: Frames, order_ids=None) -> DataFrame:
    """One row per order and known product in it, money as double."""
    items = matching(tables["order_items"].select("order_id", "product_id"), "order_id", order_ids)
    products = tables["product"].select(
        "product_id",
        "name",
        F.col("price").cast("double").alias("price"),
        "stock_count",
        F.col("rating").cast("double").alias("rating"),
    )
    return keyed_join(items, products, "product_id")


def order_details(tables: Frames, order_ids=None, page_rows: int | None = None) -> DataFrame:
    """Orders with their products nested, sorted by product id: one row per order. Only with ``page_rows`` are the products of an
    order split into rows of at most so many, numbered by ``page``."""
    products, keys = order_products(tables, order_ids), ["order_id"]
    if page_rows:
        products, keys = paged(products, page_rows), ["order_id", "page"]
    entry = F.struct("product_id", "name", "price", "stock_count", "rating")
    nested = products.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("products"))
    orders = matching(tables["order"].select("order_id", "total_price", "status"), "order_id", order_ids)
    nothing = F.array().cast(nested.schema["products"].dataType)
    return orders.join(nested, "order_id", "left").select(
        "order_id",
        F.col("total_price").cast("double").alias("total_price"),
        "status",
        *([F.coalesce("page", F.lit(0)).alias("page")] if page_rows else []),
        F.coalesce("products", nothing).alias("products"),
    )


def filter_products(
    tables: Frames,
    category_name: str | None = None,
    min_price: float | None = None,
    max_price: float | None = None,
    unknown_category: str = "ignore",
) -> DataFrame:
    """Products of a category and price range, both ends included.

    Of several categories with the name, the one with the smallest id counts. An unknown name
    switches the category filter off (``ignore``) or gives no rows (``empty``).
    """
    products = tables["product"]
    if category_name is not None:
        chosen = tables["category"].filter(F.col("name") == category_name).agg(F.min("category_id"))
        category = F.col("category_id")
        wanted = chosen.scalar()
        if unknown_category == "ignore":
            products = products.filter(wanted.isNull() | (category == wanted))
        else:
            products = products.filter(category == wanted)
    if min_price is not None:
        products = products.filter(F.col("price") >= F.lit(str(min_price)).cast("decimal(18,6)"))
    if max_price is not None:
        products = products.filter(F.col("price") <= F.lit(str(max_price)).cast("decimal(18,6)"))
    return products.select(
        "product_id",
        "name",
        F.col("price").cast("double").alias("price"),
        "stock_count",
        F.col("rating").cast("double").alias("rating"),
    )


def order_status(tables: Frames, order_ids=None) -> DataFrame:
    return matching(tables["order"], "order_id", order_ids).select("order_id", "status")
