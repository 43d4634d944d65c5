"""Write requests and unchecked rows, derived from whole given tables. ``checks/sql.py`` has the same
definitions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradepost.sources import Tables
from tradepost.functions.scan import numbered
from tradepost.sources.adapter import event_product, orders, raw_table, shop_tables

AS_OF = "2002-01-01"


def _events(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return raw_table(spark, folder, "events").filter(F.col("event_type") == kind)


def _username(number) -> F.Column:
    return F.format_string("Customer#%09d", number)


def new_products(spark: SparkSession, folder: str) -> DataFrame:
    """A product offered by each supplier; some without price, with negative stock or unknown category."""
    return raw_table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("seq"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_nationkey") != 0, F.col("s_acctbal").cast("string")).alias("price"),
        (F.col("s_nationkey") - 2).alias("stock_count"),
        (1 + F.col("s_suppkey") % 14).alias("category_id"),
    )


def favorite_requests(spark: SparkSession, folder: str) -> DataFrame:
    """A purchase event asks for one to five units of a product, which may be unknown."""
    return _events(spark, folder, "purchase").select(
        F.col("event_id").alias("seq"),
        (F.col("user_id") * 2).alias("customer_id"),
        (event_product() * 21).alias("product_id"),
        (1 + F.col("event_id") % 5).cast("int").alias("quantity"),
    )


def registrations(spark: SparkSession, folder: str) -> DataFrame:
    """A signup event registers a user: some names are taken, some signups lack the first name."""
    return _events(spark, folder, "signup").select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("First"), F.col("event_id"))).alias("first_name"),
        F.concat(F.lit("Last"), F.col("user_id")).alias("last_name"),
        F.when(F.col("user_id") % 3 == 0, _username(F.col("user_id")))
        .otherwise(F.concat(F.lit("user"), F.col("user_id")))
        .alias("username"),
        F.array("props").alias("phone_numbers"),
    )


def phone_requests(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder, "error").select(
        F.col("event_id").alias("seq"),
        (F.col("user_id") * 11).alias("customer_id"),
        F.concat(F.lit("k"), event_product()).alias("phone"),
    )


def profile_changes(spark: SparkSession, folder: str) -> DataFrame:
    """A click changes the first name, the last name, the phones, or nothing."""
    k = event_product()
    return _events(spark, folder, "click").select(
        F.col("event_id").alias("seq"),
        _username(F.col("user_id") * 11).alias("username"),
        F.when(k % 3 == 0, F.concat(F.lit("F"), F.col("event_id"))).alias("first_name"),
        F.when(k % 3 == 1, F.concat(F.lit("L"), F.col("event_id"))).alias("last_name"),
        F.when(k % 5 == 0, F.array(F.concat(F.lit("P"), F.col("event_id")))).alias("phone_numbers"),
    )


def order_heads(spark: SparkSession, folder: str) -> DataFrame:
    """Every order placed again. Those in progress are already refused, and some addresses do not belong
    to the customer."""
    return raw_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").alias("customer_id"),
        (F.col("o_custkey") * 4 + F.col("o_orderkey") % 4).alias("address_id"),
        F.when(F.col("o_orderstatus") == "P", "INCORRECT_INPUT").alias("refused"),
    )


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The line items of those orders; seventh lines name an unknown product."""
    unknown = F.when(F.col("l_linenumber") == 7, 1_000_000_000).otherwise(0)
    return raw_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("seq"),
        (F.col("l_partkey") + unknown).alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )


def order_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """The orders again as arrays, without their seventh lines; every eleventh lacks a quantity, every thirteenth has empty
    arrays, and every seventeenth none."""
    key = F.col("seq")
    lines = order_lines(spark, folder).filter("product_id < 1000000000").groupBy("seq").agg(
        F.array_sort(F.collect_list(F.struct("product_id", "quantity"))).alias("l")
    )
    heads = order_heads(spark, folder).drop("refused").join(lines, "seq")
    products, quantities = F.col("l.product_id"), F.col("l.quantity")
    none = F.array().cast("array<bigint>")
    return heads.select(
        "seq",
        "customer_id",
        "address_id",
        F.when(key % 17 != 0, F.when(key % 13 == 0, none).otherwise(products)).alias("product_ids"),
        F.when(key % 13 == 0, none.cast("array<int>"))
        .when(key % 11 == 0, F.slice(quantities, 1, F.size("l") - 1))
        .otherwise(quantities)
        .alias("quantities"),
    )


def stock_requests(items: DataFrame) -> DataFrame:
    """Order items as requests; some name no product, an unknown one or no quantity."""
    key = F.col("order_id")
    return items.select(
        key.alias("seq"),
        F.when(key % 9 == 0, None).when(key % 7 == 0, F.col("product_id") + 1_000_000_000).otherwise(F.col("product_id")).alias("product_id"),
        F.when(key % 5 != 0, F.col("quantity")).alias("quantity"),
    )


def more_customers(spark: SparkSession, folder: str) -> Tables:
    """The shop with a further customer, without orders, for every signup: some with a favorite list, with one to four
    addresses, and one order for every third of them."""
    t = shop_tables(spark, folder)
    far = 1_000_000_000
    new = _events(spark, folder, "signup").select(F.col("event_id").alias("e"))
    key = (F.col("e") + far).alias("customer_id")
    people = new.select(
        key,
        F.concat(F.lit("New"), F.col("e")).alias("first_name"),
        F.lit("Customer").alias("last_name"),
        F.concat(F.lit("new"), F.col("e")).alias("username"),
        F.lit(None).cast("decimal(10,2)").alias("wallet_balance"),
        F.array().cast("array<string>").alias("phone_numbers"),
    )
    lists = new.filter("e % 2 = 0").select(
        (F.col("e") + far).alias("favorite_id"),
        F.lit(None).cast("decimal(10,2)").alias("total_price"),
        F.lit(AS_OF).cast("timestamp_ntz").alias("create_date"),
        key,
    )
    items = new.filter("e % 2 = 0").select((F.col("e") + far).alias("favorite_id"), F.lit(1).cast("bigint").alias("product_id"), F.lit(1).alias("quantity"))
    single = new.filter("e % 3 = 0").select(
        (F.col("e") + far).alias("order_id"),
        F.lit(AS_OF).cast("timestamp_ntz").alias("order_date"),
        F.lit("1.00").cast("decimal(10,2)").alias("total_price"),
        F.lit(False).alias("status"),
        key,
        (F.col("e") + far).alias("address_id"),
    )
    homes = new.select("e", F.explode(F.sequence(F.lit(0), (F.col("e") % 4).cast("int"))).alias("i")).select(
        (F.col("e") * 4 + F.col("i") + far * 4).alias("address_id"),
        *(F.lit("x").alias(c) for c in ("street_name", "street_number", "country", "city", "postal_code", "province")),
        key,
    )
    more = {"customer": people, "favorite_list": lists, "favorite_list_items": items, "order": single, "address": homes}
    return t.replace(**{name: t[name].unionByName(rows.select(*t[name].columns)) for name, rows in more.items()})


def earlier(t: Tables) -> tuple[Tables, dict[str, DataFrame], dict[str, DataFrame]]:
    """(tables before a batch of changes, signed changes, keys of products and customers that changed). Before, items of every
    seventh order were not there, those of every fifth had one unit more, every third order after 1997 had items that were taken back,
    every eleventh product had another category and price, every sixth review was not there, every seventh had another rating
    and every fourth customer another name."""
    items, key = t["order_items"].select("order_id", "product_id", "quantity"), F.col("order_id")
    gone = items.join(t["order"].filter("order_date >= timestamp_ntz'1997-01-01' and order_id % 3 = 1").select("order_id"), "order_id", "left_semi")
    gone = gone.withColumn("quantity", F.lit(5))
    kept = items.filter(key % 7 != 0)
    old = kept.withColumn("quantity", F.col("quantity") + F.when(key % 5 == 0, 1).otherwise(0)).unionByName(gone)
    updated = kept.filter(key % 5 == 0)
    plus, minus = (lambda rows, sign=sign: rows.withColumn("sign", F.lit(sign)) for sign in (1, -1))
    item_changes = (
        plus(items.filter(key % 7 == 0))
        .unionByName(plus(updated))
        .unionByName(minus(updated.withColumn("quantity", F.col("quantity") + 1)))
        .unionByName(minus(gone))
    )
    review, rid = t["review"], F.col("review_id")
    rated = review.filter((rid % 7 == 0) & (rid % 6 != 0))
    other = F.when(rid % 7 == 0, F.when(F.col("rating").isNull(), 3).otherwise(F.col("rating") % 5 + 1)).otherwise(F.col("rating")).cast("int")
    review_changes = plus(review.filter(rid % 6 == 0)).unionByName(plus(rated)).unionByName(minus(rated.withColumn("rating", other)))
    pid, cid = F.col("product_id"), F.col("customer_id")
    categories = t["category"].agg(F.max("category_id")).first()[0]
    before = t.replace(
        order_items=old,
        product=t["product"].withColumns(
            {
                "category_id": F.when(pid % 11 == 0, F.col("category_id") % categories + 1).otherwise(F.col("category_id")),
                "price": F.when(pid % 11 == 0, F.col("price") + 1).otherwise(F.col("price")).cast(t["product"].schema["price"].dataType),
            }
        ),
        review=review.filter(rid % 6 != 0).withColumn("rating", other),
        customer=t["customer"].withColumn("first_name", F.when(cid % 4 == 0, "Once").otherwise(F.col("first_name"))),
    )
    moved = {"product_id": t["product"].filter(pid % 11 == 0).select("product_id"), "customer_id": t["customer"].filter(cid % 4 == 0).select("customer_id")}
    return before, {"order_items": item_changes, "order": t["order"], "review": review_changes}, moved


def thirds(spark: SparkSession, folder: str) -> list[tuple[int, int]]:
    """Bounds of three stretches of order keys."""
    low, high = raw_table(spark, folder, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    cuts = [low + (high - low) * i // 3 for i in range(3)] + [high + 1]
    return list(zip(cuts, cuts[1:]))


def _urgent(spark: SparkSession, folder: str) -> DataFrame:
    return raw_table(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'")


def more_discounts(spark: SparkSession, folder: str) -> DataFrame:
    """The discount codes and a second usable code for each urgent order."""
    key = F.col("o_orderkey")
    extra = _urgent(spark, folder).select(
        (key + 1_000_000_000).alias("discount_id"),
        F.concat(F.lit("E"), key).alias("code"),
        (1 + key % 30).cast("decimal(5,2)").alias("percentage"),
        F.lit(True).alias("status"),
        key.alias("order_id"),
    )
    return shop_tables(spark, folder)["discount_code"].unionByName(extra)


def more_gift_cards(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    extra = _urgent(spark, folder).select(
        (key + 1_000_000_000).alias("gift_id"),
        (1000 * (key % 90)).cast("decimal(10,2)").alias("value"),
        F.concat(F.lit("H"), key).alias("code"),
        F.lit(True).alias("status"),
        key.alias("order_id"),
    )
    return shop_tables(spark, folder)["gift_card"].unionByName(extra)


def code_requests(spark: SparkSession, folder: str, letters: tuple[str, str]) -> DataFrame:
    """Each order tries both of its possible codes twice."""
    key = F.col("o_orderkey")
    tries = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(letters[i % 2]).alias("letter")) for i in range(4)]))
    return (
        raw_table(spark, folder, "orders")
        .select(key, tries.alias("t"))
        .select(
            (key * 4 + F.col("t.i")).alias("seq"),
            key.alias("order_id"),
            F.concat(F.col("t.letter"), key).alias("code"),
        )
    )


def shared_payments(spark: SparkSession, folder: str) -> DataFrame:
    """The payments, with every second one of an order made by the customer next door."""
    payment = shop_tables(spark, folder)["payment"]
    neighbour = F.col("customer_id").bitwiseXOR(F.lit(1).cast("bigint"))
    second = F.col("payment_id") - F.col("order_id") * 3 == 1
    return payment.withColumn("customer_id", F.when(second, neighbour).otherwise(F.col("customer_id")))


def leaving_usernames(spark: SparkSession, folder: str) -> DataFrame:
    return (
        raw_table(spark, folder, "customer")
        .filter("c_mktsegment = 'BUILDING'")
        .select(F.col("c_name").alias("username"))
    )


def unchecked_tables(spark: SparkSession, folder: str) -> Tables:
    """Tables as they might arrive before any check, with broken rows of every kind."""
    good = shop_tables(spark, folder)
    raw = {n: raw_table(spark, folder, n) for n in ("customer", "part", "orders", "lineitem", "events")}
    key = F.col("o_orderkey")
    return good.replace(
        customer=good["customer"]
        .withColumn("username", F.concat(F.lit("u"), F.substring("username", 16, 3)))
        .withColumn("first_name", F.when(F.col("customer_id") % 10 != 3, F.col("first_name")))
        .withColumn("wallet_balance", raw_balance()),
        product=raw["part"].select(
            F.col("p_partkey").alias("product_id"),
            F.repeat("p_name", F.col("p_size")).alias("name"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
            (F.col("p_size") - 5).alias("stock_count"),
            (1 + F.col("p_partkey") % 14).alias("category_id"),
            F.lit("0.00").cast("decimal(5,2)").alias("rating"),
        ),
        review=raw["events"].filter("event_type = 'view'").select(
            F.col("event_id").alias("review_id"),
            F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 8).cast("int").alias("rating"),
            F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("comment"),
            F.col("user_id").alias("customer_id"),
            (event_product() * 30).alias("product_id"),
        ),
        order=orders(raw["orders"]).withColumn("address_id", F.col("address_id") + 1),
        order_items=raw["lineitem"].select(
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
        ),
        discount_code=raw["orders"].filter(key % 10 == 0).select(
            key.alias("discount_id"),
            F.concat(F.lit("D"), key % 1000).alias("code"),
            (key % 130).cast("decimal(5,2)").alias("percentage"),
            (key % 20 == 0).alias("status"),
            key.alias("order_id"),
        ),
    )


def raw_balance() -> F.Column:
    """Balances in a unit so small that some no longer fit the column."""
    return (F.col("wallet_balance").cast("decimal(18,2)") * 20000).cast("decimal(18,2)")


def raw_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews as loose text: fractional ratings, some outside 1 to 5, some not numbers, some with
    neither rating nor comment, some of unknown products."""
    return _events(spark, folder, "purchase").select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 11 == 0, F.lit("good"))
        .when(F.col("event_id") % 5 != 0, ((F.col("event_id") % 130) / 20).cast("decimal(6,2)").cast("string"))
        .alias("rating"),
        F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("comment"),
        F.col("user_id").cast("string").alias("customer_id"),
        (event_product() * 21).cast("string").alias("product_id"),
    )




def raw_seed(table: DataFrame, key: str, id_columns: tuple[str, ...], reference: str | None) -> DataFrame:
    """``table`` as loose text, every tenth row given twice, and every fifteenth once more with a new id and, in turn, an id that is no
    number or a ``reference`` to nothing."""
    far = 1_000_000_000
    rows = numbered(table.withColumn("_ids", F.struct(*id_columns)), "_ids", "seq")
    text = [F.col(f.name).cast("string").alias(f.name) if not isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in table.schema.fields]
    rows = rows.select("seq", *text)
    again = rows.filter("seq % 10 = 0").withColumn("seq", F.col("seq") + far)
    broken = rows.filter("seq % 15 = 0").withColumn("seq", F.col("seq") + 2 * far)
    wrong = F.concat(F.lit("x"), F.col(key))
    if reference:
        odd = F.col("seq") % 2 == 0
        broken = broken.withColumn(reference, F.when(odd, F.lit(str(9 * far))).otherwise(F.col(reference)))
        wrong = F.when(odd, (F.col(key).cast("bigint") + 3 * far).cast("string")).otherwise(wrong)
    return rows.unionByName(again).unionByName(broken.withColumn(key, wrong))
