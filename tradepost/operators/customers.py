"""Reports on customers, their orders, payments and addresses."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import full_name, money_sum, within
from ..functions.joins import keyed_join
from ..sources.schema import MONEY

Frames = Mapping[str, DataFrame]


def _names(tables: Frames) -> DataFrame:
    return tables["customer"].select("customer_id", full_name().alias("customer_name"))


def _orders_per_customer(orders: DataFrame) -> DataFrame:
    return orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("number_of_orders"))


def top_buyers_in_period(tables: Frames, start: str, end: str, n: int = 1) -> DataFrame:
    """The ``n`` customers with most orders in a closed period."""
    chosen = tables["order"].filter(within("order_date", start, end))
    return (
        _orders_per_customer(chosen)
        .orderBy(F.col("number_of_orders").desc(), "customer_id")
        .limit(n)
    )


def customers_without_orders(tables: Frames, start: str | None = None, end: str | None = None) -> DataFrame:
    """Customers who placed no order, or none in a closed period."""
    orders = tables["order"]
    if start is not None:
        orders = orders.filter(within("order_date", start, end))
    buyers = orders.select("customer_id").distinct()
    return tables["customer"].join(buyers, "customer_id", "left_anti").select(
        "customer_id", "first_name", "last_name", "username", "wallet_balance"
    )


def top_payers_by_city(tables: Frames, city: str | None = None, dedupe: bool = False) -> DataFrame:
    """Per city and customer with an address there: the sum paid for the customer's orders, the dearest
    product in a paid order and the latest such order.

    A customer with k addresses in a city has the sum counted k times; ``dedupe`` counts it once.
    Sort by city and falling total at the sink.
    """
    homes = tables["address"]
    if city is not None:
        homes = homes.filter(F.col("city") == city)
    homes = homes.groupBy("city", "customer_id").agg(F.count(F.lit(1)).alias("homes"))
    orders = tables["order"].select("order_id", "customer_id", "order_date")
    if city is not None:
        orders = keyed_join(orders, homes.select("customer_id"), "customer_id", "left_semi")
    paid = tables["payment"].groupBy("order_id").agg(F.sum("amount").alias("paid"))
    paid_orders = keyed_join(orders, paid, "order_id")
    items = tables["order_items"].select("order_id", "product_id")
    if city is not None:
        items = keyed_join(items, orders.select("order_id"), "order_id", "left_semi")
    dearest = (
        keyed_join(items, tables["product"].select("product_id", "price"), "product_id")
        .groupBy("order_id")
        .agg(F.max("price").alias("dearest"))
    )
    spent = (
        paid_orders.join(dearest, "order_id", "left")
        .groupBy("customer_id")
        .agg(
            F.sum("paid").alias("paid"),
            F.max("dearest").alias("most_expensive_product_price"),
            F.max("order_date").alias("last_order_date"),
        )
    )
    times = F.lit(1) if dedupe else F.col("homes")
    totals = keyed_join(homes, spent, "customer_id").withColumn(
        "total_payments", (F.col("paid") * times).cast("decimal(18,2)")
    )
    return keyed_join(totals, _names(tables), "customer_id").select(
        "city",
        "customer_id",
        "customer_name",
        "total_payments",
        F.col("most_expensive_product_price").cast(MONEY).alias("most_expensive_product_price"),
        "last_order_date",
    )


def top_payers_in_city(tables: Frames, city: str, dedupe: bool = False) -> DataFrame:
    """The customers of one city, highest payer first."""
    return (
        top_payers_by_city(tables, city, dedupe)
        .drop("city")
        .orderBy(F.col("total_payments").desc_nulls_first(), "customer_id")
    )


def favorites_but_no_order(tables: Frames, start: str | None = None, end: str | None = None) -> DataFrame:
    """Customers with a favorite list who placed no order, or none in a closed period."""
    idle = customers_without_orders(tables, start, end)
    return idle.join(tables["favorite_list"].select("customer_id"), "customer_id", "left_semi").select(
        "customer_id", full_name().alias("customer_name")
    )


def top_customers_by_order_value(tables: Frames, n: int = 1) -> DataFrame:
    """The ``n`` customers with the largest sum of order totals. A customer whose totals are all
    missing has no sum and comes first, as a falling sort puts NULL first."""
    spent = tables["order"].groupBy("customer_id").agg(
        money_sum(F.col("total_price")).alias("total_amount_of_orders")
    )
    # The reference from order to customer is required, so the top can be taken before the join.
    top = spent.orderBy(F.col("total_amount_of_orders").desc_nulls_first(), "customer_id").limit(n)
    return keyed_join(top, _names(tables), "customer_id").select(
        "customer_id", "customer_name", "total_amount_of_orders"
    )


def single_order_customers_by_addresses(
    tables: Frames, n: int = 1, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Among customers with exactly one order (in a closed period), the ``n`` with most addresses."""
    orders = tables["order"]
    if start is not None:
        orders = orders.filter(within("order_date", start, end))
    single = _orders_per_customer(orders).filter("number_of_orders = 1").select("customer_id")
    counted = (
        tables["address"]
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("num_of_addresses"))
        .join(single, "customer_id", "left_semi")
    )
    return (
        counted.join(_names(tables), "customer_id")
        .orderBy(F.col("num_of_addresses").desc(), "customer_id")
        .limit(n)
        .select("customer_id", "customer_name", "num_of_addresses")
    )


def payment_details(tables: Frames) -> DataFrame:
    """Payments with the city and country the order is shipped to."""
    orders = tables["order"].select("order_id", "address_id")
    places = tables["address"].select("address_id", "city", "country")
    shipped = keyed_join(orders, places, "address_id")
    return keyed_join(tables["payment"], shipped, "order_id").select(
        "payment_id", "payment_date", F.col("amount").alias("total_amount"), "city", "country"
    )


def user_orders(tables: Frames) -> DataFrame:
    """Orders of known customers."""
    orders = tables["order"].select("customer_id", "order_id", "total_price")
    return keyed_join(orders, tables["customer"].select("customer_id"), "customer_id", "left_semi")


def total_spending_per_user(tables: Frames) -> DataFrame:
    """Sum of payments by the customer who paid; customers without a payment are left out."""
    spent = tables["payment"].groupBy("customer_id").agg(money_sum(F.col("amount")).alias("total_spent"))
    people = tables["customer"].select("customer_id", "first_name", "last_name")
    return keyed_join(spent, people, "customer_id").select(
        "customer_id", "first_name", "last_name", "total_spent"
    )
