"""Shop tables derived from the TPC-H-like driver tables (see FIXTURES.md section 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .reader import Tables
from .schema import MONEY, RATE, TABLES

# The driver tables' columns.
RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def raw_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def event_product() -> F.Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def customers(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("c_custkey").alias("customer_id"),
        F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("last_name"),
        F.col("c_name").alias("username"),
        F.greatest("c_acctbal", F.lit(0.0)).cast(MONEY).alias("wallet_balance"),
        F.array(F.format_string("%d-%03d", "c_nationkey", F.col("c_custkey") % 1000)).alias("phone_numbers"),
    )


def addresses(raw: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    homes = raw.select(
        "c_custkey",
        "c_nationkey",
        "c_mktsegment",
        F.explode(F.sequence(F.lit(0), (F.col("c_custkey") % 3).cast("int"))).alias("i"),
    ).withColumn("n_nationkey", (F.col("c_nationkey") + F.col("i")) % 25)
    # Both name tables have a fixed number of rows: 25 nations in 5 regions.
    return homes.join(F.broadcast(places), "n_nationkey").select(
        (F.col("c_custkey") * 4 + F.col("i")).alias("address_id"),
        F.col("c_mktsegment").alias("street_name"),
        F.col("i").cast("string").alias("street_number"),
        F.col("r_name").alias("country"),
        F.col("n_name").alias("city"),
        F.col("c_custkey").cast("string").alias("postal_code"),
        F.col("r_name").alias("province"),
        F.col("c_custkey").alias("customer_id"),
    )


def categories(part: DataFrame) -> DataFrame:
    """Two categories per part type. The window runs over the distinct types, not over parts."""
    kinds = part.select(F.col("p_type").alias("name"), (F.col("p_partkey") % 2).alias("half")).distinct()
    return kinds.select(
        F.dense_rank().over(Window.orderBy("name", "half")).cast("bigint").alias("category_id"), "name", "half"
    )


def products(part: DataFrame) -> DataFrame:
    # Part types come from a fixed word list, so there are a few hundred categories at any scale.
    kinds = categories(part)
    return (
        part.withColumn("half", F.col("p_partkey") % 2)
        .withColumnRenamed("p_type", "kind")
        .join(
            F.broadcast(kinds.withColumnRenamed("name", "kind")),
            ["kind", "half"],
        )
        .select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("p_retailprice").cast(MONEY).alias("price"),
            (F.col("p_size") * 10).alias("stock_count"),
            "category_id",
            F.lit("0.00").cast(RATE).alias("rating"),
        )
    )


def orders(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_totalprice").cast(MONEY).alias("total_price"),
        (F.col("o_orderstatus") == "F").alias("status"),
        F.col("o_custkey").alias("customer_id"),
        (F.col("o_custkey") * 4).alias("address_id"),
    )


def order_items(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id")
    ).agg(F.sum("l_quantity").cast("int").alias("quantity"))


def reviews(events: DataFrame) -> DataFrame:
    silent = F.col("event_id") % 4 == 0
    return events.filter("event_type = 'view'").select(
        F.col("event_id").alias("review_id"),
        F.when(~silent, 1 + F.col("event_id") % 5).cast("int").alias("rating"),
        F.when(silent, F.col("props")).alias("comment"),
        F.col("user_id").alias("customer_id"),
        event_product().alias("product_id"),
    )


def favorite_lists(events: DataFrame) -> DataFrame:
    return (
        events.filter("event_type = 'click'")
        .groupBy("user_id")
        .agg(F.min("ts").alias("create_date"))
        .select(
            F.col("user_id").alias("favorite_id"),
            F.lit("0.00").cast(MONEY).alias("total_price"),
            "create_date",
            F.col("user_id").alias("customer_id"),
        )
    )


def favorite_items(events: DataFrame) -> DataFrame:
    return (
        events.filter("event_type = 'click'")
        .groupBy(F.col("user_id").alias("favorite_id"), event_product().alias("product_id"))
        .agg(F.count(F.lit(1)).cast("int").alias("quantity"))
    )


def payments(order: DataFrame) -> DataFrame:
    share = F.element_at(
        F.array(*[F.lit(x).cast("decimal(3,2)") for x in ("0.25", "0.50", "1.00", "0.40")]),
        (F.col("order_id") % 4 + 1).cast("int"),
    )
    return order.select(
        "order_id",
        "customer_id",
        "order_date",
        (F.col("total_price") * share).cast(MONEY).alias("amount"),
        F.explode(F.sequence(F.lit(0), (F.col("order_id") % 3).cast("int"))).alias("i"),
    ).select(
        (F.col("order_id") * 3 + F.col("i")).alias("payment_id"),
        "amount",
        F.lit("card").alias("method"),
        F.expr("order_date + make_dt_interval(i)").alias("payment_date"),
        "order_id",
        "customer_id",
    )


def discount_codes(order: DataFrame) -> DataFrame:
    key = F.col("order_id")
    return order.filter(key % 10 == 0).select(
        key.alias("discount_id"),
        F.concat(F.lit("D"), key).alias("code"),
        (5 * (1 + key % 4)).cast(RATE).alias("percentage"),
        (key % 20 == 0).alias("status"),
        key.alias("order_id"),
    )


def gift_cards(order: DataFrame) -> DataFrame:
    key = F.col("order_id")
    return order.filter(key % 15 == 0).select(
        key.alias("gift_id"),
        (10 + key % 90).cast(MONEY).alias("value"),
        F.concat(F.lit("G"), key).alias("code"),
        (key % 2 == 0).alias("status"),
        key.alias("order_id"),
    )


def shop_tables(spark: SparkSession, folder: str) -> Tables:
    raw = Tables(
        spark, {name: (lambda name=name: raw_table(spark, folder, name)) for name in RAW_SCHEMAS}
    )
    return Tables(
        spark,
        {
            "customer": lambda: customers(raw["customer"]),
            "address": lambda: addresses(raw["customer"], raw["nation"], raw["region"]),
            "category": lambda: categories(raw["part"]).drop("half"),
            "product": lambda: products(raw["part"]),
            "review": lambda: reviews(raw["events"]),
            "favorite_list": lambda: favorite_lists(raw["events"]),
            "favorite_list_items": lambda: favorite_items(raw["events"]),
            "order": lambda: orders(raw["orders"]),
            "payment": lambda: payments(orders(raw["orders"])),
            "order_items": lambda: order_items(raw["lineitem"]),
            "discount_code": lambda: discount_codes(orders(raw["orders"])),
            "gift_card": lambda: gift_cards(orders(raw["orders"])),
            "order_history_log": lambda: spark.createDataFrame(
                [], TABLES["order_history_log"].schema
            ),
        },
    )
