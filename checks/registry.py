"""Every registered query: name -> function of session and data folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradepost.functions.durable import work_folder
from tradepost.operators import apply, cascade, customers, derive, lookups, promos, quality, reviews, sales, stock, wallet
from tradepost.plans import catalog
from tradepost.session import configure
from tradepost.sources import TABLES, Tables, shop_tables
from tradepost.sources.ingest import ingest
from tradepost.streaming import jobs

from . import requests as ask

Query = Callable[[SparkSession, str], DataFrame]

YEAR = ("1996-01-01", "1997-01-01")
HALF = ("1996-01-01", "1996-06-30")
MONEY = "decimal(18,2)"

QUERIES: dict[str, Query] = {}


def over_tables(name: str, build: Callable[[Tables], DataFrame]) -> None:
    """Register a query that only needs the shop tables."""
    QUERIES[name] = lambda spark, folder: build(shop_tables(configure(spark), folder))


def registered(function: Query) -> Query:
    QUERIES[function.__name__] = lambda spark, folder: function(configure(spark), folder)
    return function


def _counts(tables, keys: dict[str, str]) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            tables[name].agg(F.count(F.lit(1)).alias("n_rows"), F.sum(key).cast("bigint").alias("key_sum")).select(
                F.lit(name).alias("table_name"), "n_rows", "key_sum"
            )
            for name, key in keys.items()
        ],
    )


# ---- tables
over_tables("load_tables", lambda t: _counts(t, {name: _id_column(name) for name in TABLES}))


def _id_column(name: str) -> str:
    return TABLES[name].key[0]


def _ingested(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    t = shop_tables(spark, folder)
    return ingest(ask.raw_reviews(spark, folder), TABLES["review"], t["review"], {"product": t["product"]})


@registered
def ingest_rows(spark, folder):
    return _ingested(spark, folder)[0].drop("seq")


@registered
def ingest_rejects(spark, folder):
    return _ingested(spark, folder)[1].select("seq", F.array_join("reasons", ",").alias("reasons"))


# Table: (id columns, a column that refers to another table).
SEEDED = {
    "customer": (("customer_id",), None),
    "address": (("address_id",), "customer_id"),
    "category": (("category_id",), None),
    "product": (("product_id",), "category_id"),
    "favorite_list": (("favorite_id",), "customer_id"),
    "favorite_list_items": (("favorite_id", "product_id"), "product_id"),
    "order": (("order_id",), "customer_id"),
    "payment": (("payment_id",), "order_id"),
    "order_items": (("order_id", "product_id"), "product_id"),
    "discount_code": (("discount_id",), "order_id"),
    "gift_card": (("gift_id",), "order_id"),
}


def _seed(spark, folder, name):
    t, (ids, reference) = shop_tables(configure(spark), folder), SEEDED[name]
    raw = ask.raw_seed(t[name], ids[0], ids, None if reference == ids[-1] else reference)
    return ingest(raw, TABLES[name], None, {n: t[n] for n in t if n != name})


for _name in SEEDED:
    QUERIES[f"ingest_{_name}"] = lambda spark, folder, name=_name: _seed(spark, folder, name)[0].select(*LEFT[name])


@registered
def ingest_seed_rejects(spark, folder):
    """Why rows of which table were refused."""
    found = []
    for name in SEEDED:
        reasons = _seed(spark, folder, name)[1].select(F.lit(name).alias("table_name"), F.explode("reasons").alias("reason"))
        found.append(reasons.groupBy("table_name", "reason").agg(F.count(F.lit(1)).alias("n_rows")))
    return reduce(DataFrame.unionByName, found)


@registered
def view_catalog(spark, folder):
    names = catalog.register_views(shop_tables(spark, folder))
    return reduce(
        DataFrame.unionByName,
        [spark.table(name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("view_name"), "n_rows") for name in names],
    )


def _snapshot(name: str) -> None:
    """A stored summary written and read back."""

    def read_back(spark, folder):
        t, path = shop_tables(configure(spark), folder), work_folder(spark, "snapshot")
        catalog.write_summaries(t, path, [name])
        return catalog.read_summary(t, name, path)

    QUERIES[f"mv_snapshot_{name}"] = read_back


def _refreshed(name: str) -> None:
    """A stored summary of earlier tables, brought up to date by what has changed since."""

    def refresh(spark, folder):
        t, path = shop_tables(configure(spark), folder), work_folder(spark, "refresh")
        before, changes, moved = ask.earlier(t)
        catalog.write_summaries(before, path, [name])
        return catalog.refresh_summary(name, 1, changes, t, path, moved.get(catalog.SUMMARIES[name].moved))

    QUERIES[f"mv_refresh_{name}"] = refresh


for _name in catalog.SUMMARIES:
    _snapshot(_name)
    _refreshed(_name)


@registered
def mv_snapshot(spark, folder):
    """All summaries written, one of them read back."""
    t, path = shop_tables(spark, folder), work_folder(spark, "snapshot")
    catalog.write_summaries(t, path)
    return catalog.read_summary(t, "monthly_report", path)


@registered
def mv_refresh(spark, folder):
    """The monthly summary built from the orders of three stretches of time in turn."""
    t = shop_tables(spark, folder)
    path = work_folder(spark, "refresh")
    first, second = (F.col("order_date") < F.lit(d).cast("timestamp_ntz") for d in ("1995-01-01", "1998-01-01"))
    for batch, stretch in enumerate([first, ~first & second, ~second]):
        result = catalog.refresh_summary("monthly_report", batch, t.replace(order=t["order"].filter(stretch)), t, path)
    return result


# ---- analytic queries
over_tables("top_buyers_in_period", lambda t: customers.top_buyers_in_period(t, *YEAR, n=10))
over_tables("best_selling_product", lambda t: sales.best_selling_products(t, n=10))
over_tables("product_reviews_with_favorites", reviews.product_reviews_with_favorites)
over_tables("reviewers_who_favorited", reviews.reviewers_who_favorited)
over_tables("order_item_history", lambda t: sales.order_item_history(t, "1998-01-01"))
over_tables("customers_without_orders", lambda t: customers.customers_without_orders(t, *HALF))
over_tables("top_payers_by_city", customers.top_payers_by_city)
over_tables("top_payers_in_city", lambda t: customers.top_payers_in_city(t, "NATION_7"))
over_tables("avg_rating_per_product", reviews.avg_rating_per_product)
over_tables("products_without_review", reviews.products_without_review)
over_tables("favorites_but_no_order", lambda t: customers.favorites_but_no_order(t, *HALF))
over_tables("top_customer_by_order_value", lambda t: customers.top_customers_by_order_value(t, n=10))
over_tables(
    "single_order_customers_by_addresses",
    lambda t: customers.single_order_customers_by_addresses(t, 25, "1900-01-01", "1996-01-01"),
)

# The source takes all orders; in the given tables every such customer has some, so the answers need customers without.
QUERIES["customers_without_orders_all"] = lambda s, f: customers.customers_without_orders(ask.more_customers(configure(s), f))
QUERIES["favorites_but_no_order_all"] = lambda s, f: customers.favorites_but_no_order(ask.more_customers(configure(s), f))
QUERIES["single_order_customers_by_addresses_all"] = lambda s, f: customers.single_order_customers_by_addresses(
    ask.more_customers(configure(s), f), 25
)

# ---- functions
over_tables("total_sales", lambda t: sales.total_sales(t, *YEAR))
over_tables("total_sales_of_product", lambda t: sales.total_sales(t, *YEAR, product_id=7))
over_tables("total_sales_by_product", lambda t: sales.total_sales_by_product(t, "1996-01-01", "1996-02-01"))
over_tables("monthly_sales_category", lambda t: sales.monthly_sales_category(t, 1996, 12))
over_tables("average_product_rating", reviews.average_product_rating)

# ---- views and stored summaries
over_tables("payment_details", customers.payment_details)
over_tables("users_favorites", reviews.users_favorites)
over_tables("user_orders", customers.user_orders)
over_tables("popular_products", sales.popular_products)
over_tables("total_spending_per_user", customers.total_spending_per_user)
over_tables("reviews", reviews.customer_reviews)
over_tables("product_summary", sales.product_summary)
over_tables("discount_summary", sales.discount_summary)
over_tables("sales_by_category", sales.sales_by_category)
over_tables("monthly_report", sales.monthly_report)


# ---- lookups
@registered
def customer_by_username(spark, folder):
    return lookups.customer_by_username(shop_tables(spark, folder), ask.profile_changes(spark, folder))


@registered
def addresses_of_customer(spark, folder):
    t = shop_tables(spark, folder)
    users = ask.raw_table(spark, folder, "events").select(F.col("user_id").alias("customer_id"))
    return lookups.addresses_of_customer(t, users)


over_tables(
    "order_details",
    lambda t: lookups.order_details(t).select("order_id", "total_price", "status", F.inline_outer("products")),
)
over_tables("filter_products", lambda t: lookups.filter_products(t, "STANDARD", 905, 960))
over_tables("order_status", lookups.order_status)


# ---- batches of requests
@registered
def add_products(spark, folder):
    return apply.add_products(shop_tables(spark, folder), ask.new_products(spark, folder))[0]["product"]


@registered
def add_products_log(spark, folder):
    return apply.add_products(shop_tables(spark, folder), ask.new_products(spark, folder))[1]


def _favorites(spark, folder):
    return apply.add_to_favorites(shop_tables(spark, folder), ask.favorite_requests(spark, folder), ask.AS_OF)


@registered
def add_to_favorites(spark, folder):
    return _favorites(spark, folder)[0]["favorite_list_items"]


@registered
def add_to_favorites_lists(spark, folder):
    return _favorites(spark, folder)[0]["favorite_list"].withColumn("total_price", F.col("total_price").cast(MONEY))


@registered
def add_to_favorites_stock(spark, folder):
    return _favorites(spark, folder)[0]["product"].select("product_id", "stock_count")


@registered
def add_to_favorites_log(spark, folder):
    return _favorites(spark, folder)[1]


@registered
def register_customers(spark, folder):
    changed, _ = apply.register_customers(shop_tables(spark, folder), ask.registrations(spark, folder))
    return changed["customer"].drop("phone_numbers")


@registered
def register_customers_log(spark, folder):
    return apply.register_customers(shop_tables(spark, folder), ask.registrations(spark, folder))[1]


@registered
def add_phone_numbers(spark, folder):
    return apply.add_phone_numbers(shop_tables(spark, folder), ask.phone_requests(spark, folder))[0]


@registered
def phone_arrays(spark, folder):
    """The customer table with the added phones in its arrays."""
    t = shop_tables(spark, folder)
    added = apply.add_phone_numbers(t, ask.phone_requests(spark, folder))[0]
    return apply.phone_arrays(t["customer"], added).select("customer_id", F.array_join("phone_numbers", ",").alias("phone_numbers"))


@registered
def update_customers(spark, folder):
    changed, _ = apply.update_customers(shop_tables(spark, folder), ask.profile_changes(spark, folder))
    return changed["customer"].select(
        "customer_id", "first_name", "last_name", "username", F.array_join("phone_numbers", ",").alias("phone_numbers")
    )


@registered
def update_customers_log(spark, folder):
    return apply.update_customers(shop_tables(spark, folder), ask.profile_changes(spark, folder))[1]


def _orders(spark, folder):
    t = shop_tables(spark, folder)
    return apply.place_orders(t, ask.order_heads(spark, folder), ask.order_lines(spark, folder), ask.AS_OF)


@registered
def create_orders(spark, folder):
    return _orders(spark, folder)[0]["order"].select(
        "order_id", "customer_id", "address_id", "status", F.col("total_price").cast(MONEY).alias("total_price")
    )


@registered
def create_orders_log(spark, folder):
    return _orders(spark, folder)[1]


@registered
def create_orders_stock(spark, folder):
    return _orders(spark, folder)[0]["product"].select("product_id", "stock_count")


@registered
def create_orders_items(spark, folder):
    return _orders(spark, folder)[0]["order_items"]


@registered
def create_orders_arrays(spark, folder):
    """Orders given as arrays of products and quantities, some empty, missing or of unequal length."""
    return apply.create_orders(shop_tables(spark, folder), ask.order_arrays(spark, folder), ask.AS_OF)[1]


def _discounts(spark, folder):
    return promos.apply_discounts(
        shop_tables(spark, folder)["order"], ask.more_discounts(spark, folder), ask.code_requests(spark, folder, ("D", "E"))
    )


@registered
def apply_discounts(spark, folder):
    return _discounts(spark, folder).orders.select("order_id", F.col("total_price").cast(MONEY).alias("total_price"))


@registered
def apply_discounts_log(spark, folder):
    return _discounts(spark, folder).log


@registered
def apply_discounts_codes(spark, folder):
    return _discounts(spark, folder).codes


def _gifts(spark, folder):
    return promos.apply_gift_cards(
        shop_tables(spark, folder)["order"], ask.more_gift_cards(spark, folder), ask.code_requests(spark, folder, ("G", "H"))
    )


@registered
def apply_gift_cards(spark, folder):
    return _gifts(spark, folder).orders.select("order_id", F.col("total_price").cast(MONEY).alias("total_price"))


@registered
def apply_gift_cards_log(spark, folder):
    return _gifts(spark, folder).log


@registered
def apply_gift_cards_codes(spark, folder):
    return _gifts(spark, folder).codes.select("gift_id", "code", "status", "order_id")


def _every_third(spark, folder, letters):
    return ask.code_requests(spark, folder, letters).filter("order_id % 3 = 1")


@registered
def apply_discounts_unrequested(spark, folder):
    """Only every third order asks, so most usable codes stay usable."""
    t = shop_tables(spark, folder)
    return promos.apply_discounts(t["order"], ask.more_discounts(spark, folder), _every_third(spark, folder, ("D", "E"))).codes


@registered
def apply_gift_cards_unrequested(spark, folder):
    t = shop_tables(spark, folder)
    used = promos.apply_gift_cards(t["order"], ask.more_gift_cards(spark, folder), _every_third(spark, folder, ("G", "H"))).codes
    return used.select("gift_id", "code", "status", "order_id")


#: Columns by which rows of a table are compared.
LEFT = {
    "customer": ["customer_id", "first_name", "last_name", "username"],
    "address": ["address_id", "customer_id"],
    "category": ["category_id", "name"],
    "product": ["product_id", "name", "price", "stock_count", "category_id"],
    "review": ["review_id", "rating", "customer_id", "product_id"],
    "favorite_list": ["favorite_id", "customer_id"],
    "favorite_list_items": ["favorite_id", "product_id", "quantity"],
    "order": ["order_id", "order_date", "total_price", "status", "customer_id"],
    "payment": ["payment_id", "amount", "payment_date", "order_id", "customer_id"],
    "order_items": ["order_id", "product_id", "quantity"],
    "discount_code": ["discount_id", "code", "percentage", "status", "order_id"],
    "gift_card": ["gift_id", "code", "value", "status", "order_id"],
}


def _left_rows(name):
    def left(spark, folder):
        t = shop_tables(configure(spark), folder)
        return cascade.delete_customers(t, ask.leaving_usernames(spark, folder))[name].select(*LEFT[name])

    QUERIES[f"delete_customers_{name}"] = left


for _name in LEFT:
    if _name not in ("category", "product"):
        _left_rows(_name)


@registered
def delete_customers(spark, folder):
    t = shop_tables(spark, folder)
    left = cascade.delete_customers(t, ask.leaving_usernames(spark, folder))
    return _counts(left, {name: _id_column(name) for name in left if name != "order_history_log"})


# ---- derived values
over_tables("favorite_totals", lambda t: derive.favorite_totals(t).drop("create_date"))
over_tables("order_totals", lambda t: derive.order_totals(t).select("order_id", "total_price"))


@registered
def validate_order_address(spark, folder):
    asked = ask.order_heads(spark, folder).select(F.col("seq").alias("order_id"), "customer_id", "address_id")
    return derive.check_order_addresses(asked, shop_tables(spark, folder)["address"])


over_tables("payment_progress", derive.payment_progress)
over_tables("payment_settlement", derive.payment_settlement)
over_tables("wallet_ledger", lambda t: wallet.wallet_ledger(t).drop("payment_date"))


def _settled(t: Tables) -> dict[str, DataFrame]:
    return wallet.settle_with_wallet(t, wallet.wallet_ledger(t))


over_tables("settled_orders", lambda t: _settled(t)["order"].select("order_id", "status"))
over_tables(
    "settled_wallets",
    lambda t: _settled(t)["customer"].select("customer_id", F.col("wallet_balance").cast(MONEY).alias("wallet_balance")),
)
over_tables(
    "settled_payments", lambda t: _settled(t)["payment"].select("payment_id", F.col("amount").cast(MONEY).alias("amount"))
)


@registered
def wallet_ledger_status(spark, folder):
    """Orders divisible by 9 and customers divisible by 10 are not known."""
    t = shop_tables(spark, folder)
    known = t.replace(order=t["order"].filter("order_id % 9 <> 0"), customer=t["customer"].filter("customer_id % 10 <> 0"))
    return wallet.payments_with_status(known).drop("payment_date")


@registered
def payment_progress_status(spark, folder):
    """Orders divisible by 9 are not known."""
    t = shop_tables(spark, folder)
    return derive.payment_progress(t.replace(order=t["order"].filter("order_id % 9 <> 0")))


@registered
def wallet_ledger_shared(spark, folder):
    t = shop_tables(spark, folder)
    return wallet.wallet_ledger(t.replace(payment=ask.shared_payments(spark, folder))).drop("payment_date")


over_tables("product_ratings", lambda t: derive.product_ratings(t).select("product_id", "rating"))


def _allocated(t: Tables) -> DataFrame:
    wanted = t["order_items"].withColumn("seq", F.col("order_id"))
    return stock.allocate_stock(wanted, t["product"])


over_tables("allocate_stock", lambda t: _allocated(t).drop("seq", "status"))


@registered
def allocate_stock_status(spark, folder):
    """Requests among which some name no product, an unknown one or no quantity."""
    t = shop_tables(spark, folder)
    return stock.allocate_stock(ask.stock_requests(t["order_items"]), t["product"])


over_tables(
    "allocate_stock_remaining",
    lambda t: stock.remaining_stock(_allocated(t), t["product"]).select("product_id", "stock_count"),
)
over_tables("review_notifications", lambda t: derive.review_notifications(t["review"]))


@registered
def order_history(spark, folder):
    return derive.history_json(derive.order_history(shop_tables(spark, folder), as_of=ask.AS_OF))


@registered
def history_sink(spark, folder):
    """The history of three stretches of orders appended to one table and read back."""
    t = shop_tables(spark, folder)
    path = work_folder(spark, "history")
    paid = derive.paid_orders(t["order"])
    for batch, (low, high) in enumerate(ask.thirds(spark, folder)):
        some = paid.filter((F.col("order_id") >= low) & (F.col("order_id") < high))
        jobs.add_history(spark, lambda last: derive.order_history(t, some, as_of=ask.AS_OF, last_id=last), path, batch)
    return jobs.history(spark, path)


# ---- data quality
def _unchecked(name: str, report) -> None:
    QUERIES[name] = lambda spark, folder: report(ask.unchecked_tables(configure(spark), folder))


_unchecked("dq_not_null", quality.dq_not_null)
_unchecked("dq_unique", quality.dq_unique)
_unchecked("dq_foreign_keys", quality.dq_foreign_keys)
_unchecked("dq_checks", quality.dq_checks)
_unchecked("dq_domain", quality.dq_domain)
_unchecked(
    "violating_keys",
    lambda t: quality.violating_keys(t).groupBy("table_name", "rule").agg(F.count(F.lit(1)).alias("found"), F.min("row_key").alias("first")),
)
