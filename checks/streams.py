"""Registered streaming jobs, each run over a whole given table that arrives in three batches or more; between batches the stream
ends and is started again from its checkpoint."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from tradepost.functions.durable import cut, work_folder
from tradepost.operators.wallet import payer_groups
from tradepost.sources.adapter import orders, payments, raw_table, reviews, shop_tables
from tradepost.streaming import jobs
from tradepost.streaming.runner import append_to, file_stream, finish

from . import requests as ask
from .registry import registered


def _place(spark, name):
    path = work_folder(spark, name)
    return f"{path}/out", f"{path}/checkpoint"


def _arriving(spark, rows, key, start):
    """Run the stream that ``start`` makes from a stream of ``rows`` once for each third of the range of ``key``, in turn.
    The rows are made once."""
    path, rows = work_folder(spark, "arriving"), cut(rows)
    low, high = rows.agg(F.min(key), F.max(key)).first()
    bounds = [low, low + (high - low) // 3, low + (high - low) * 2 // 3, high + 1]
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        rows.filter((key >= a) & (key < b)).write.parquet(f"{path}/{i}")
        finish(start(file_stream(spark, f"{path}/*", rows.schema)))


def _third(key, low, high):
    """0, 1 or 2: the third of the range in which ``key`` lies."""
    return F.when(key < low + (high - low) / 3, 0).when(key < low + (high - low) * 2 / 3, 1).otherwise(2)


def _in_parts(spark, events, last, start, after=()):
    """Run the stream that ``start`` makes once for each value of ``part`` up to ``last``; then with each of ``after`` added.
    The rows are made once, each in the folder of its part, and the stream is shown one folder more each time."""
    path, schema = work_folder(spark, "arriving"), events.drop("part").schema
    with _open_writers(spark, last + 1):
        events.write.partitionBy("part").parquet(path)
    for i in range(last + 1 + len(after)):
        if i > last:
            after[i - last - 1].write.parquet(f"{path}/part={i}")
        shown = ",".join(map(str, range(i + 1)))
        finish(start(file_stream(spark, f"{path}/part={{{shown}}}", schema)))


@contextmanager
def _open_writers(spark, n):
    """Let a task write ``n`` folders side by side, so that it need not sort its rows by folder."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _items(spark, folder):
    return raw_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )


@registered
def stream_order_totals(spark, folder):
    path, checkpoint = _place(spark, "totals")
    t = shop_tables(spark, folder)
    _arriving(spark, _items(spark, folder), F.col("order_id"), lambda rows: jobs.stream_totals(rows, lambda: t, "order_id", path, checkpoint))
    return jobs.with_totals(t["order"], t["product"], path, "order_id").select("order_id", "total_price")


@registered
def stream_order_totals_late_products(spark, folder):
    """Every fifth product gets its price only after all items have come."""
    path, checkpoint = _place(spark, "totals")
    t = shop_tables(spark, folder)
    early = t.replace(product=t["product"].filter("product_id % 5 <> 0"))
    _arriving(spark, _items(spark, folder), F.col("order_id"), lambda rows: jobs.stream_totals(rows, lambda: early, "order_id", path, checkpoint))
    return jobs.with_totals(t["order"], t["product"], path, "order_id").select("order_id", "total_price")


@registered
def stream_favorite_totals(spark, folder):
    path, checkpoint = _place(spark, "lists")
    t = shop_tables(spark, folder)
    clicks = (
        raw_table(spark, folder, "events")
        .filter("event_type = 'click'")
        .select(
            "event_id",
            F.col("user_id").alias("favorite_id"),
            ask.event_product().alias("product_id"),
            F.lit(1).alias("quantity"),
        )
    )
    _arriving(spark, clicks, F.col("event_id"), lambda rows: jobs.stream_totals(rows, lambda: t, "favorite_id", path, checkpoint))
    return jobs.with_totals(t["favorite_list"], t["product"], path, "favorite_id").drop("create_date")


@registered
def stream_product_ratings(spark, folder):
    path, checkpoint = _place(spark, "ratings")
    written = reviews(raw_table(spark, folder, "events"))
    _arriving(spark, written, F.col("review_id"), lambda rows: jobs.stream_product_ratings(rows, path, checkpoint))
    return jobs.ratings(spark, path)


def _gate(spark, folder, asked):
    """Requests in three thirds of their numbers, every seventh a third late; numbers are seconds."""
    path, checkpoint = _place(spark, "gate")
    t = shop_tables(spark, folder)
    low, high = asked.agg(F.min("seq"), F.max("seq")).first()
    events = jobs.stock_events(asked.withColumn("time", F.timestamp_seconds("seq")), t["product"], "time", F.timestamp_seconds(F.lit(low - 1)))
    part = _third(F.col("id"), low, high) + F.when(F.col("id") % 7 == 0, 1).otherwise(0)
    events = events.withColumn("part", F.when(F.col("kind") == "stock", 0).otherwise(part))
    delay = f"{(high - low) // 3 + 2} seconds"
    end = jobs.clock_event(events.drop("part"), "product_id", F.timestamp_seconds(F.lit(2 * high + 10)))
    _in_parts(spark, events, 3, lambda rows: jobs.stream_stock_gate(rows, path, checkpoint, delay), [end])
    return spark.read.parquet(path)


@registered
def stream_stock_gate(spark, folder):
    asked = shop_tables(spark, folder)["order_items"].withColumn("seq", F.col("order_id"))
    return _gate(spark, folder, asked).select("product_id", F.col("seq").alias("order_id"), "quantity", "accepted")


@registered
def stream_stock_gate_status(spark, folder):
    asked = ask.stock_requests(shop_tables(spark, folder)["order_items"])
    return _gate(spark, folder, asked).select("seq", "product_id", "quantity", "accepted", "status")


def _wallets(spark, folder, keep_order, accounts=None, payments_of=lambda made: made):
    """Payments and orders in three thirds of time, every seventh payment and every tenth order a third late; then the end."""
    path, checkpoint = _place(spark, "wallets")
    t = shop_tables(spark, folder)
    made = payments_of(payments(orders(raw_table(spark, folder, "orders"))))
    low, high = (d.timestamp() for d in made.agg(F.min("payment_date").cast("timestamp"), F.max("payment_date").cast("timestamp")).first())
    opened = F.timestamp_seconds(F.lit(low))
    events = jobs.wallet_events(made, t["order"].filter(keep_order), t["customer"], opened, accounts)
    late = ((F.col("kind") == "row") & (F.col("id") % 7 == 0)) | ((F.col("kind") == "order") & (F.col("order_id") % 10 == 0))
    third = _third(F.unix_seconds("at"), low, high)
    events = events.withColumn("part", F.when(F.col("kind") == "wallet", 0).otherwise(third + F.when(late, 1).otherwise(0)))
    delay = f"{int(high - low) // 3 + 86400} seconds"
    end = jobs.clock_event(events.drop("part"), "account", F.timestamp_seconds(F.lit(int(2 * high))))
    _in_parts(spark, events, 3, lambda rows: jobs.stream_wallet_ledger(rows, path, checkpoint, delay, "30 days"), [end])
    return spark.read.parquet(path)


_LEDGER = ["payment_id", "customer_id", "order_id", "order_paid", "stored_amount", "paid_sum", "wallet_after"]


@registered
def stream_wallet_ledger(spark, folder):
    return _wallets(spark, folder, F.lit(True)).select(*_LEDGER)


@registered
def stream_wallet_ledger_status(spark, folder):
    """Orders divisible by 9 are never known."""
    return _wallets(spark, folder, F.col("order_id") % 9 != 0).select(*_LEDGER, "status")


@registered
def stream_wallet_ledger_shared(spark, folder):
    """Two customers pay for orders of each other and so have one account."""
    made = ask.shared_payments(spark, folder)
    accounts = payer_groups(made).select("customer_id", F.col("_group").alias("account"))
    return _wallets(spark, folder, F.lit(True), accounts, lambda _: made).select(*_LEDGER)


@registered
def stream_order_address_check(spark, folder):
    path, checkpoint = _place(spark, "addresses")
    t = shop_tables(spark, folder)
    asked = raw_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        (F.col("o_custkey") * 4 + F.col("o_orderkey") % 4).alias("address_id"),
    )
    _arriving(spark, asked, F.col("order_id"), lambda rows: jobs.stream_order_address_check(rows, lambda: t, path, checkpoint))
    return spark.read.parquet(path).drop("batch")


@registered
def stream_review_notifications(spark, folder):
    path, checkpoint = _place(spark, "notices")
    written = reviews(raw_table(spark, folder, "events"))
    _arriving(spark, written, F.col("review_id"), lambda rows: jobs.stream_review_notifications(rows, path, checkpoint))
    return spark.read.parquet(path)


@registered
def stream_order_history(spark, folder):
    path, checkpoint = _place(spark, "history")
    t = shop_tables(spark, folder)
    paid = t["order"].filter("status").select("order_id")

    def history(rows):
        return jobs.stream_order_history(rows, lambda: t, path, checkpoint, as_of=ask.AS_OF)

    _arriving(spark, paid, F.col("order_id"), history)
    return jobs.history(spark, path)


@registered
def stream_order_history_once(spark, folder):
    """Every order is set to paid twice, the second time a day later and one batch later."""
    path, checkpoint = _place(spark, "history")
    t = shop_tables(spark, folder)
    low, high = t["order"].agg(F.min("order_id"), F.max("order_id")).first()
    paid = t["order"].filter("status").select("order_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"))
    part = _third(F.col("order_id"), low, high) + F.col("again")
    paid = paid.select("order_id", F.timestamp_seconds(F.col("order_id") + F.col("again") * 86400).alias("paid_at"), part.alias("part"))
    within = f"{(high - low) + 2 * 86400} seconds"
    _in_parts(spark, paid, 3, lambda rows: jobs.stream_order_history(rows, lambda: t, path, checkpoint, within, ask.AS_OF))
    return jobs.history(spark, path)


def _sold(spark, folder):
    dates = raw_table(spark, folder, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("timestamp").alias("order_date"))
    sold = _items(spark, folder).join(dates, "order_id").withColumns({"sign": F.lit(1), "quantity": F.col("quantity").cast("bigint")})
    return sold.select("order_id", "product_id", "quantity", "sign", "order_date")


def _daily(spark, folder, delay):
    """Items by order number, which says nothing about the date."""
    path, checkpoint = _place(spark, "days")
    _arriving(spark, _sold(spark, folder), F.col("order_id"), lambda rows: jobs.stream_daily_sales(rows, path, checkpoint, delay))
    return path


@registered
def stream_daily_sales(spark, folder):
    path = _daily(spark, folder, "4000 days")
    return jobs.monthly_report_from_days(jobs.daily_units(spark, path), shop_tables(spark, folder))


@registered
def stream_daily_sales_late(spark, folder):
    return jobs.late_units(spark, _daily(spark, folder, "30 days"))


@registered
def stream_daily_sales_on_time(spark, folder):
    return jobs.daily_units(spark, _daily(spark, folder, "30 days"))


@registered
def stream_dated_items(spark, folder):
    """Items and orders as two streams; every third order comes one batch after its items."""
    path, checkpoint = _place(spark, "dated")
    known_at = F.timestamp_seconds(F.col("order_id") + 86400).alias("known_at")
    items = _items(spark, folder).withColumn("sign", F.lit(1))
    low, high = items.agg(F.min("order_id"), F.max("order_id")).first()
    both = items.select("order_id", "product_id", "quantity", "sign", F.lit(None).cast("timestamp").alias("order_date"), known_at).unionByName(
        raw_table(spark, folder, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("timestamp").alias("order_date"), F.timestamp_seconds(F.col("o_orderkey") + 86400).alias("known_at")),
        allowMissingColumns=True,
    )
    late = F.when(F.col("product_id").isNull() & (F.col("order_id") % 3 == 0), 1).otherwise(0)
    both = both.withColumn("part", _third(F.col("order_id"), low, high) + late)

    def dated(rows):
        found = jobs.dated_items(rows.filter("product_id is not null").drop("order_date"), rows.filter("product_id is null"), f"{high - low + 60} seconds")
        return append_to(found, path, checkpoint)

    _in_parts(spark, both, 3, dated)
    return spark.read.parquet(path).withColumn("order_date", F.col("order_date").cast("timestamp_ntz"))
