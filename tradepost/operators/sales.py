"""Reports on orders, items, products and categories.

Items are the largest table, so names and prices are looked up after items have been added up by
product, or on the way when the lookup needs no shuffle. Prices are the products' current ones: items store
none, so past revenue moves when a price changes.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import full_name, money_sum, month_of, month_range, whole_sum, within
from ..functions.joins import keyed_join
from ..sources.schema import MONEY_SUM

Frames = Mapping[str, DataFrame]


def _category_names(tables: Frames) -> DataFrame:
    return tables["category"].select("category_id", F.col("name").alias("category_name"))


def units_by_product(items: DataFrame) -> DataFrame:
    return items.groupBy("product_id").agg(whole_sum("quantity").alias("units"))


def best_selling_products(tables: Frames, n: int = 1) -> DataFrame:
    """The ``n`` products of which most units were ordered."""
    products = tables["product"].select("product_id", F.col("name").alias("product_name"), "price", "category_id")
    sold = keyed_join(units_by_product(tables["order_items"]), products, "product_id")
    return (
        keyed_join(sold, _category_names(tables), "category_id")
        .orderBy(F.col("units").desc_nulls_first(), "product_id")
        .limit(n)
        .select("product_id", "product_name", "price", "category_name", "units")
    )


def order_item_history(tables: Frames, as_of: str) -> DataFrame:
    """Items of the orders placed before ``as_of`` with customer, price and category. Unsorted: sort at
    the place it is written to, by customer and order."""
    past = tables["order"].filter(F.col("order_date") < F.lit(as_of).cast("timestamp_ntz"))
    past = past.select("order_id", "customer_id")
    buyers = tables["customer"].select("customer_id", full_name().alias("customer_name"))
    products = tables["product"].select("product_id", F.col("name").alias("product_name"), "price", "category_id")
    named = keyed_join(products, _category_names(tables), "category_id").drop("category_id")
    orders = keyed_join(past, buyers, "customer_id")
    items = tables["order_items"].select("order_id", "product_id")
    sold = keyed_join(items, named, "product_id")
    return keyed_join(sold, orders, "order_id").select(
        "customer_id", "customer_name", "order_id", "product_id", "product_name", "price", "category_name"
    )


def total_sales_by_product(tables: Frames, start: str, end: str) -> DataFrame:
    """Sales of every product in a closed period, 0 for a product that did not sell."""
    chosen = tables["order"].filter(within("order_date", start, end))
    items = tables["order_items"].select("order_id", "product_id", "quantity")
    sold = units_by_product(keyed_join(items, chosen.select("order_id"), "order_id", "left_semi"))
    return tables["product"].select("product_id", "price").join(sold, "product_id", "left").select(
        "product_id",
        (F.coalesce("units", F.lit(0)) * F.col("price")).cast(MONEY_SUM).alias("total_sales"),
    )


def total_sales(tables: Frames, start: str, end: str, product_id: int | None = None) -> DataFrame:
    """One row: sales of the whole shop or of one product in a closed period, 0 if there are none."""
    items, products = tables["order_items"], tables["product"].select("product_id", "price")
    if product_id is not None:
        items, products = (df.filter(F.col("product_id") == product_id) for df in (items, products))
    chosen = tables["order"].filter(within("order_date", start, end)).select("order_id")
    items = items.select("order_id", "product_id", "quantity")
    sold = units_by_product(keyed_join(items, chosen, "order_id", "left_semi"))
    return keyed_join(sold, products, "product_id").agg(
        F.coalesce(F.sum(F.col("units") * F.col("price")), F.lit(0)).cast(MONEY_SUM).alias("total_sales")
    )


def category_sales(items: DataFrame, product: DataFrame, *keys: str) -> DataFrame:
    """Units and revenue per category id and ``keys`` of items (product_id, quantity, keys).

    Items are first added up by product, so that the join with the price list moves one row per product and key, and no
    product is heavy any more.
    """
    prices = product.filter("category_id is not null").select("product_id", "price", "category_id")
    by_product = items.groupBy("product_id", *keys).agg(whole_sum("quantity").alias("units"))
    sold = keyed_join(by_product, prices, "product_id")
    return sold.groupBy("category_id", *keys).agg(
        whole_sum("units").alias("units"), money_sum(F.col("units") * F.col("price")).alias("revenue")
    )


def monthly_sales_category(tables: Frames, year: int, month: int) -> DataFrame:
    """Sales and units of one month per category id; two categories of one name stay two rows."""
    chosen = tables["order"].filter(month_range("order_date", year, month)).select("order_id")
    items = tables["order_items"].select("order_id", "product_id", "quantity")
    by_category = category_sales(keyed_join(items, chosen, "order_id", "left_semi"), tables["product"])
    return keyed_join(by_category, _category_names(tables), "category_id").select(
        "category_id", "category_name", F.col("revenue").alias("total_sales"), F.col("units").alias("products_sold")
    )


def popular_products(tables: Frames) -> DataFrame:
    """Units sold per product. Unsorted."""
    names = tables["product"].select("product_id", F.col("name").alias("product_name"))
    return keyed_join(units_by_product(tables["order_items"]), names, "product_id").select(
        "product_id", "product_name", F.col("units").alias("total_quantity_sold")
    )


def product_summary_from_units(units: DataFrame, product: DataFrame) -> DataFrame:
    return product.join(units, "product_id", "left").select(
        "product_id",
        F.col("name").alias("product_name"),
        "price",
        "stock_count",
        F.coalesce("units", F.lit(0)).cast("bigint").alias("times_purchased"),
    )


def product_summary(tables: Frames) -> DataFrame:
    """Every product with price, stock and the units bought, 0 if none."""
    return product_summary_from_units(units_by_product(tables["order_items"]), tables["product"])


def _named_category_sales(by_category: DataFrame, category: DataFrame) -> DataFrame:
    return keyed_join(by_category, category, "category_id").select(
        "category_id", "name", F.col("units").alias("total_quantity_sold"), F.col("revenue").alias("total_sales")
    )


def sales_by_category_from_units(units: DataFrame, product: DataFrame, category: DataFrame) -> DataFrame:
    sold = units.withColumnRenamed("units", "quantity")
    return _named_category_sales(category_sales(sold, product), category)


def sales_by_category(tables: Frames, check_orders: bool = False) -> DataFrame:
    """Units and revenue per category id. ``check_orders`` leaves out items without an order, for
    tables whose references were not checked."""
    items = tables["order_items"]
    if check_orders:
        items = keyed_join(items, tables["order"].select("order_id"), "order_id", "left_semi")
    return _named_category_sales(category_sales(items, tables["product"]), tables["category"])


def _items_by_month(tables: Frames) -> DataFrame:
    orders = tables["order"].select("order_id", month_of("order_date").alias("sales_month"))
    return keyed_join(tables["order_items"].select("order_id", "product_id", "quantity"), orders, "order_id")


def monthly_units(tables: Frames) -> DataFrame:
    """Units per product and month. These add up, so later items can be merged in; prices are looked up
    last because revenue follows the current price."""
    return _items_by_month(tables).groupBy("product_id", "sales_month").agg(whole_sum("quantity").alias("units"))


def _by_category_name(by_category: DataFrame, category: DataFrame) -> DataFrame:
    names = category.select("category_id", F.col("name").alias("category_name"))
    return (
        keyed_join(by_category, names, "category_id")
        .groupBy("category_name", "sales_month")
        .agg(
            whole_sum("units").alias("total_products_sold"),
            money_sum(F.col("revenue")).alias("total_revenue"),
        )
    )


def monthly_report_from_units(units: DataFrame, product: DataFrame, category: DataFrame) -> DataFrame:
    sold = units.withColumnRenamed("units", "quantity")
    return _by_category_name(category_sales(sold, product, "sales_month"), category)


def monthly_report(tables: Frames) -> DataFrame:
    """Units and revenue per category name and month; categories of one name are one row."""
    by_category = category_sales(_items_by_month(tables), tables["product"], "sales_month")
    return _by_category_name(by_category, tables["category"])


def discount_summary(tables: Frames) -> DataFrame:
    """Usable discount codes with their order's total."""
    codes = tables["discount_code"].filter("status").select(
        "order_id", F.col("code").alias("discount_code"), F.col("percentage").alias("discount_percentage")
    )
    return keyed_join(codes, tables["order"].select("order_id", "total_price"), "order_id").select(
        "order_id", "discount_code", "discount_percentage", "total_price"
    )
