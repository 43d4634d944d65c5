"""Batches of write requests. Each job takes the current tables and a DataFrame of requests with a
unique arrival number ``seq`` and returns the new tables and a log with one status per request."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import extended
from ..functions.durable import cut
from ..functions.joins import keyed_join
from ..functions.scan import new_ids, position
from ..sources.ingest import ingest
from ..sources.schema import MONEY, TABLES
from .derive import check_order_addresses, favorite_totals, order_totals
from .stock import allocate_stock, remaining_stock

Frames = Mapping[str, DataFrame]
Result = tuple[dict[str, DataFrame], DataFrame]


def _log(accepted: DataFrame, rejected: DataFrame, *carried: str) -> DataFrame:
    done = accepted.select("seq", F.lit("DONE").alias("status"), *carried)
    refused = rejected.select("seq", F.array_join("reasons", ",").alias("status"))
    return done.unionByName(refused, allowMissingColumns=True)


def add_products(tables: Frames, requests: DataFrame) -> Result:
    """Insert products (seq, name, price, stock_count, category_id); ids go on after the largest."""
    accepted, rejected = ingest(requests, TABLES["product"], tables["product"], {"category": tables["category"]})
    product = tables["product"].unionByName(accepted.drop("seq"))
    return {"product": product}, _log(accepted, rejected, "product_id")


def register_customers(tables: Frames, requests: DataFrame) -> Result:
    """Insert customers (seq, first_name, last_name, username, phone_numbers) whose username is free; the
    first valid request for a username gets it."""
    accepted, rejected = ingest(requests, TABLES["customer"], tables["customer"])
    customer = tables["customer"].unionByName(accepted.drop("seq"))
    return {"customer": customer}, _log(accepted, rejected, "customer_id")


def add_phone_numbers(tables: Frames, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Phone numbers (seq, customer_id, phone) added after those the customer has.

    Returns all phones as rows (customer_id, position, phone), which stays spread out for a customer
    with any number of them, and the log. ``phone_arrays`` puts them back into the customer table.
    """
    customer = tables["customer"].select(
        "customer_id", F.coalesce(F.size("phone_numbers"), F.lit(0)).alias("_have"), F.lit(True).alias("_known")
    )
    judged = keyed_join(requests.select("seq", "customer_id", "phone"), customer, "customer_id", "left")
    known = judged.filter("_known")
    added = position(known, ["customer_id"], "seq", "_nth").select(
        "customer_id", (F.greatest("_have", F.lit(0)) + F.col("_nth")).cast("bigint").alias("position"), "phone"
    )
    old = tables["customer"].select("customer_id", F.posexplode("phone_numbers").alias("_pos", "phone")).select(
        "customer_id", (F.col("_pos") + 1).cast("bigint").alias("position"), "phone"
    )
    log = judged.select("seq", F.when(F.col("_known"), "DONE").otherwise("UNKNOWN_CUSTOMER").alias("status"))
    return old.unionByName(added), log


def phone_arrays(customer: DataFrame, added: DataFrame) -> DataFrame:
    """The customer table with ``added`` phones (customer_id, position, phone) put after the array; the
    array a customer already has is not collected again."""
    had = F.greatest(F.coalesce(F.size("phone_numbers"), F.lit(0)), F.lit(0))
    sizes = customer.select("customer_id", had.alias("_have"))
    fresh = keyed_join(added, sizes, "customer_id").filter(F.col("position") > F.col("_have"))
    lists = fresh.groupBy("customer_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "phone"))), lambda x: x["phone"]).alias("_new")
    )
    return (
        customer.join(lists, "customer_id", "left")
        .withColumn(
            "phone_numbers",
            F.when(F.col("_new").isNotNull(), extended("phone_numbers", "_new")).otherwise(F.col("phone_numbers")),
        )
        .select(*customer.columns)
    )


def update_customers(tables: Frames, requests: DataFrame) -> Result:
    """Patch customers by username (seq, username, first_name, last_name, phone_numbers): per field the
    latest request that gives it wins."""
    fields = ["first_name", "last_name", "phone_numbers"]
    given = F.lit(False)
    for f in fields:
        given = given | F.col(f).isNotNull()
    known = tables["customer"].select("username", F.lit(True).alias("_known"))
    judged = keyed_join(requests, known, "username", "left").withColumn(
        "status",
        F.when(F.col("_known").isNull(), "UNKNOWN_CUSTOMER").when(~given, "NO_FIELDS").otherwise("DONE"),
    )
    latest = judged.filter("status = 'DONE'").groupBy("username").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"_{f}") for f in fields]
    )
    customer = tables["customer"].join(latest, "username", "left")
    for f in fields:
        customer = customer.withColumn(f, F.coalesce(f"_{f}", f))
    return {"customer": customer.select(*tables["customer"].columns)}, judged.select("seq", "username", "status")


def add_to_favorites(tables: Frames, requests: DataFrame, as_of: str) -> Result:
    """Put products on favorite lists (seq, customer_id, product_id, quantity). A list is made for a
    customer without one, quantities of a product already listed add up, and the stock is reserved:
    a request for more than is left is skipped."""
    people = tables["customer"].select("customer_id", F.lit(True).alias("_person"))
    goods = tables["product"].select("product_id", F.lit(True).alias("_product"))
    judged = keyed_join(
        keyed_join(requests.select("seq", "customer_id", "product_id", "quantity"), people, "customer_id", "left"),
        goods,
        "product_id",
        "left",
    ).withColumn(
        "status",
        F.when(F.col("_person").isNull(), "UNKNOWN_CUSTOMER")
        .when(F.col("_product").isNull(), "UNKNOWN_PRODUCT")
        .when(F.col("quantity").isNull(), "NO_QUANTITY"),
    )
    refused = judged.filter("status is not null").select("seq", "status")
    allocated = cut(
        allocate_stock(
            judged.filter("status is null").select("seq", "customer_id", "product_id", "quantity"), tables["product"]
        )
    )
    taken = allocated.filter("accepted")
    lists = tables["favorite_list"]
    owners = taken.groupBy("customer_id").agg(F.min("seq").alias("seq"))
    without = owners.join(lists.select("customer_id"), "customer_id", "left_anti")
    made = cut(new_ids(without, lists, "favorite_id", "seq")).select(
        "favorite_id",
        F.lit("0.00").cast(MONEY).alias("total_price"),
        F.lit(as_of).cast("timestamp_ntz").alias("create_date"),
        "customer_id",
    )
    all_lists = lists.unionByName(made)
    added = keyed_join(
        taken.groupBy("customer_id", "product_id").agg(F.sum("quantity").alias("quantity")),
        all_lists.select("favorite_id", "customer_id"),
        "customer_id",
    ).select("favorite_id", "product_id", "quantity")
    items = (
        tables["favorite_list_items"]
        .unionByName(added)
        .groupBy("favorite_id", "product_id")
        .agg(F.sum("quantity").cast("int").alias("quantity"))
    )
    changed = {
        "favorite_list": all_lists,
        "favorite_list_items": items,
        "product": remaining_stock(allocated, tables["product"]),
    }
    touched = keyed_join(all_lists, owners.select("customer_id"), "customer_id", "left_semi").select("favorite_id")
    totals = favorite_totals(
        {
            "favorite_list": all_lists.join(touched, "favorite_id", "left_semi"),
            "favorite_list_items": keyed_join(items, touched, "favorite_id", "left_semi"),
            "product": tables["product"],
        }
    )
    changed["favorite_list"] = (
        all_lists.join(totals.select("favorite_id", F.col("total_price").alias("_total")), "favorite_id", "left")
        .withColumn("total_price", F.coalesce("_total", "total_price").cast(MONEY))
        .drop("_total")
    )
    log = allocated.select("seq", F.when(F.col("accepted"), "DONE").otherwise("EXCEEDS_STOCK").alias("status"))
    return changed, log.unionByName(refused)


def create_orders(tables: Frames, requests: DataFrame, as_of: str) -> Result:
    """Place orders (seq, customer_id, address_id, product_ids, quantities); see ``place_orders``. Arrays that
    are empty or differ in length are refused."""
    sized = F.coalesce(
        (F.size("product_ids") > 0) & (F.size("product_ids") == F.size("quantities")), F.lit(False)
    )
    heads = requests.select(
        "seq", "customer_id", "address_id", F.when(~sized, F.lit("INCORRECT_INPUT")).alias("refused")
    )
    pairs = requests.filter(sized).select("seq", F.explode(F.arrays_zip("product_ids", "quantities")).alias("_pair"))
    lines = pairs.select(
        "seq", F.col("_pair.product_ids").alias("product_id"), F.col("_pair.quantities").alias("quantity")
    )
    return place_orders(tables, heads, lines, as_of)


def place_orders(tables: Frames, heads: DataFrame, lines: DataFrame, as_of: str) -> Result:
    """Place orders given as heads (seq, customer_id, address_id, refused) and lines (seq, product_id,
    quantity), so that an order may have any number of lines.

    An order is refused as a whole, before it takes any stock, when ``refused`` already says why, it has
    no lines, the address is not the customer's, a product is unknown or named twice, or a quantity is
    missing. Otherwise the order exists even if each of its items is skipped for lack of stock. The log
    has one row per refused order and one per item of the others.
    """
    merged = cut(
        lines.groupBy("seq", "product_id").agg(
            F.count(F.lit(1)).alias("_times"),
            F.count_if(F.col("quantity").isNull()).alias("_missing"),
            F.max("quantity").alias("quantity"),
        )
    )
    goods = tables["product"].select("product_id", F.lit(True).alias("_product"))
    faults = (
        keyed_join(merged, goods, "product_id", "left")
        .groupBy("seq")
        .agg(
            (F.max("_times") > 1).alias("_twice"),
            (F.max("_missing") > 0).alias("_missing"),
            F.bool_or(F.col("_product").isNull()).alias("_unknown"),
        )
    )
    judged = cut(
        check_order_addresses(heads, tables["address"])
        .join(faults, "seq", "left")
        .withColumn(
            "refused",
            F.when(F.col("refused").isNotNull(), F.col("refused"))
            .when(F.col("_twice").isNull(), "INCORRECT_INPUT")
            .when(~F.col("accepted"), "ADDRESS_NOT_OF_CUSTOMER")
            .when(F.col("_twice"), "PRODUCT_TWICE")
            .when(F.col("_missing"), "NO_QUANTITY")
            .when(F.col("_unknown"), "UNKNOWN_PRODUCT"),
        )
        .select("seq", "customer_id", "address_id", "refused")
    )
    placed = new_ids(judged.filter("refused is null").drop("refused"), tables["order"], "order_id", "seq")
    new_orders = placed.select(
        "order_id",
        F.lit(as_of).cast("timestamp_ntz").alias("order_date"),
        F.lit("0.00").cast(MONEY).alias("total_price"),
        F.lit(False).alias("status"),
        "customer_id",
        "address_id",
    )
    # A product occurs once in an order, so the order's arrival number is unique within a product.
    wanted = keyed_join(merged.select("seq", "product_id", "quantity"), placed.select("seq", "order_id"), "seq")
    allocated = cut(allocate_stock(wanted, tables["product"]))
    new_items = allocated.filter("accepted").select(F.col("quantity").cast("int").alias("quantity"), "order_id", "product_id")
    totalled = order_totals({"order": new_orders, "order_items": new_items, "product": tables["product"]})
    changed = {
        "order": tables["order"].unionByName(totalled.withColumn("total_price", F.col("total_price").cast(MONEY))),
        "order_items": tables["order_items"].unionByName(new_items),
        "product": remaining_stock(allocated, tables["product"]),
    }
    log = allocated.select(
        "seq", "order_id", "product_id", F.when(F.col("accepted"), "DONE").otherwise("EXCEEDS_STOCK").alias("status")
    )
    refused = judged.filter("refused is not null").select("seq", F.col("refused").alias("status"))
    return changed, log.unionByName(refused, allowMissingColumns=True)
