"""Streaming forms of the derived values.

A change stream has the columns of its table and ``sign``: +1 for a row that appears and -1 for one
that goes away; an update is one of each. Static tables are given as a function, called for
every batch, so that a batch sees the prices and addresses of its time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.batches import newest, put_batch, stored
from ..functions.columns import mean
from ..functions.durable import cut
from ..functions.joins import reduced
from ..operators.derive import check_order_addresses, history_json, notice_columns, order_history
from ..operators.sales import monthly_report_from_units
from ..sources.schema import MONEY_SUM, RATE, TABLES
from .runner import append_to, file_stream, start
from .stateful import BUCKETS, NONE, Dated, LateSplit, Settlement, StockGate, dated, in_order, missing, number

Frames = Mapping[str, DataFrame]
Now = Callable[[], Frames]

_SUM = MONEY_SUM.simpleString()


def _signed(changes: DataFrame) -> DataFrame:
    return changes if "sign" in changes.columns else changes.withColumn("sign", F.lit(1))


# ---- totals -------------------------------------------------------------------------------------


def stream_totals(items: DataFrame, tables: Now, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the total of each order (``key`` order_id) or favorite list (favorite_id) up to date. Each batch adds what its
    items are worth at the prices of its time; a total is the sum over batches. Units of a product that has no price yet are
    kept open and count at its price once it has one."""

    def on_batch(rows: DataFrame, batch: int) -> None:
        units = _signed(rows).groupBy(key, "product_id").agg(F.sum(F.col("sign") * F.col("quantity")).alias("units"))
        units = cut(units)
        prices = reduced(tables()["product"].select("product_id", "price"), units, "product_id")
        priced = units.join(prices, "product_id", "left")
        # What has a price is added up at once; the open units stay apart by product.
        product = F.when(F.col("price").isNull(), F.col("product_id")).alias("open_product")
        open_units = F.sum(F.when(F.col("price").isNull(), F.col("units"))).cast("bigint").alias("open_units")
        worth = F.sum(F.col("units") * F.col("price")).cast(MONEY_SUM).alias("worth")
        put_batch(priced.groupBy(key, product).agg(worth, open_units), path, batch)

    return start(items, on_batch, checkpoint)


def with_totals(owners: DataFrame, product: DataFrame, path: str, key: str) -> DataFrame:
    """``owners`` (orders or lists) with the totals that the stream has written to ``path``; one without any keeps its own."""
    rows = stored(owners.sparkSession, path, f"{key} bigint, open_product bigint, worth {_SUM}, open_units bigint")
    late = reduced(product.select(F.col("product_id").alias("open_product"), "price"), rows.filter("open_product is not null"), "open_product")
    worth = F.coalesce("worth", F.col("open_units") * F.col("price"))
    totals = rows.join(late, "open_product", "left").groupBy(key).agg(F.sum(worth).cast(MONEY_SUM).alias("_total"))
    return (
        owners.join(totals, key, "left")
        .withColumn("total_price", F.coalesce("_total", "total_price").cast(MONEY_SUM))
        .drop("_total")
    )


# ---- ratings ------------------------------------------------------------------------------------


def stream_product_ratings(reviews: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the mean rating of each reviewed product, NULL while none of its reviews is rated."""
    parts = _signed(reviews).groupBy("product_id").agg(
        F.coalesce(F.sum(F.col("sign") * F.col("rating")), F.lit(0)).alias("_sum"),
        F.sum(F.when(F.col("rating").isNotNull(), F.col("sign")).otherwise(0)).alias("_n"),
    )
    means = parts.select("product_id", mean("_sum", "_n").cast(RATE).alias("rating"))
    return start(means, lambda rows, batch: put_batch(rows, path, batch), checkpoint, "update")


def ratings(spark: SparkSession, path: str) -> DataFrame:
    return newest(stored(spark, path, f"product_id bigint, rating {RATE.simpleString()}"), "product_id")


# ---- stock --------------------------------------------------------------------------------------


def stock_events(requests: DataFrame, product: DataFrame, time: str, opened) -> DataFrame:
    """Events for ``stream_stock_gate`` from requests (seq, product_id, quantity and ``time``) and products, whose stock is
    known from the time ``opened`` on."""
    asked = requests.select(
        number("product_id"), F.lit("row").alias("kind"), F.col(time).cast("timestamp").alias("at"), F.col("seq").cast("bigint").alias("id"), number("quantity")
    )
    stock = product.select(
        number("product_id"), F.lit("stock").alias("kind"), opened.cast("timestamp").alias("at"), F.lit(0).cast("bigint").alias("id"), number("stock_count").alias("quantity")
    )
    return asked.unionByName(stock)


def clock_event(like: DataFrame, key: str, at) -> DataFrame:
    """One event of no key that only moves the watermark to ``at``; it closes a stream whose last rows still wait."""
    values = {key: F.lit(NONE), "kind": F.lit("clock"), "at": at.cast("timestamp")}
    one = like.sparkSession.range(1)
    return one.select(*(values.get(n, F.lit(0)).cast(t).alias(n) for n, t in like.dtypes))


def stream_stock_gate(events: DataFrame, path: str, checkpoint: str, delay: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Accept or skip the requests of each product in the order of (time, id) against the stock that earlier ones left, see
    ``stock_events``. Requests may come in any order within ``delay``; a request waits until the watermark has passed its time.
    Appends product_id, seq, quantity, accepted, status, stock_left and late to a parquet table; every request gets a row. Products are
    dealt to ``buckets``, each with one state; their number stays with the checkpoint."""
    judged = in_order(events, "at", delay, StockGate(), buckets)
    rows = judged.select(missing("product_id"), missing("seq"), missing("quantity").cast("int").alias("quantity"), "accepted", "status", missing("stock_left"), "late")
    return append_to(rows, path, checkpoint)


# ---- wallets ------------------------------------------------------------------------------------


def wallet_events(payments: DataFrame, orders: DataFrame, customers: DataFrame, opened, accounts: DataFrame | None = None) -> DataFrame:
    """Events for ``stream_wallet_ledger``: payments at their date, orders at theirs, and wallets as they are at ``opened``.

    Payments of one account are taken in order. An account is a customer, or a group of customers who pay for orders of each other:
    ``accounts`` (customer_id, account) names the account of those."""

    def cents(name: str):
        return F.coalesce((F.col(name) * 100).cast("bigint"), F.lit(NONE)).alias("cents")

    def events(rows: DataFrame, kind: str, at, ident, order, amount) -> DataFrame:
        return rows.select(
            number("customer_id"), F.lit(kind).alias("kind"), at.cast("timestamp").alias("at"), ident.cast("bigint").alias("id"), order.alias("order_id"), amount
        )

    nothing = F.lit(NONE)
    every = (
        events(payments, "row", F.col("payment_date"), F.col("payment_id"), number("order_id"), cents("amount"))
        .unionByName(events(orders, "order", F.col("order_date"), nothing, number("order_id"), cents("total_price")))
        .unionByName(events(customers, "wallet", opened, nothing, nothing, F.coalesce((F.col("wallet_balance") * 100).cast("bigint"), F.lit(0)).alias("cents")))
    )
    if accounts is None:
        return every.withColumn("account", F.col("customer_id"))
    return every.join(accounts, "customer_id", "left").withColumn("account", F.coalesce("account", "customer_id"))


def stream_wallet_ledger(
    events: DataFrame, path: str, checkpoint: str, delay: str, keep: str = "365 days", buckets: int = BUCKETS
) -> StreamingQuery:
    """Settle payments with wallets in the order of (date, id), see ``wallet_events``.

    Events may come in any order within ``delay``: a payment waits until the watermark has passed its date, so an order that comes
    after its payments is known in time. Wallets, orders and their paid sums are in the state store, by ``buckets`` of accounts; a paid order leaves it
    when nothing was paid for it during ``keep``. Appends a row for every payment to a parquet table; one whose order or customer is not
    known by then settles nothing and says so in its status, as does a payment of an order that has left."""
    keep_ms = int(events.sparkSession.sql(f"select cast(unix_millis(timestamp'1970-01-01' + interval {keep}) - unix_millis(timestamp'1970-01-01') as bigint)").first()[0])
    settled = in_order(events, "at", delay, Settlement(keep_ms), buckets)

    def money(name: str, alias: str):
        return F.when(F.col(name) != NONE, (F.col(name).cast("decimal(20,0)") / 100).cast(MONEY_SUM)).alias(alias)

    rows = settled.select(
        missing("payment_id"),
        F.timestamp_millis(missing("at_ms")).cast("timestamp_ntz").alias("payment_date"),
        missing("customer_id"),
        missing("order_id"),
        "order_paid",
        money("stored", "stored_amount"),
        money("paid", "paid_sum"),
        money("wallet", "wallet_after"),
        "status",
        "late",
    )
    return append_to(rows, path, checkpoint)


# ---- checks, notices and history ----------------------------------------------------------------


def stream_order_address_check(orders: DataFrame, tables: Now, path: str, checkpoint: str) -> StreamingQuery:
    """Append every new order with ``accepted``: does the address belong to the customer?"""

    def on_batch(rows: DataFrame, batch: int) -> None:
        put_batch(check_order_addresses(rows, tables()["address"]), path, batch)

    return start(orders, on_batch, checkpoint)


def stream_review_notifications(reviews: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    kind, text = notice_columns()
    notices = reviews.select("review_id", "product_id", "customer_id", kind.alias("kind"), text.alias("message"))
    return append_to(notices, path, checkpoint)


_LOG = ", ".join(
    f"{f.name} {'string' if f.name == 'order_details' else f.dataType.simpleString()}" for f in TABLES["order_history_log"].schema.fields
)


def history(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the order history table written below ``path``."""
    return stored(spark, f"{path}/log", _LOG).drop("batch")


def add_history(spark: SparkSession, rows_of: Callable[[int], DataFrame], path: str, batch: int) -> None:
    """Append ``rows_of`` (last id) as one batch. How many rows a batch has is kept beside the log, which is not read."""
    counts = stored(spark, f"{path}/counts", "n bigint")
    last = counts.filter(F.col("batch") < batch).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    put_batch(history_json(rows_of(last)), f"{path}/log", batch)
    put_batch(stored(spark, f"{path}/log", _LOG).filter(F.col("batch") == batch).agg(F.count(F.lit(1)).alias("n")), f"{path}/counts", batch)


def stream_order_history(
    paid: DataFrame, tables: Now, path: str, checkpoint: str, dedupe_within: str | None = None, as_of: str | None = None
) -> StreamingQuery:
    """Append a row of the order history table for each paid transition (order_id), its document as JSON. Ids go on
    after those of earlier batches. With ``dedupe_within`` (such as "7 days") transitions have a time ``paid_at``, and an order that is
    set to paid again within that time of the first is not logged again; Spark's state store keeps the orders of that time only."""
    spark = paid.sparkSession
    if dedupe_within:
        paid = paid.withWatermark("paid_at", dedupe_within).dropDuplicatesWithinWatermark(["order_id"])

    def on_batch(rows: DataFrame, batch: int) -> None:
        events = cut(rows.select("order_id"))
        now = tables()
        few = {name: reduced(now[name], events, "order_id") for name in ("order", "order_items")}
        add_history(
            spark, lambda last: order_history({**few, "product": now["product"]}, paid=events, as_of=as_of, last_id=last), path, batch
        )

    return start(paid, on_batch, checkpoint)


# ---- sales --------------------------------------------------------------------------------------

_SPREAD = 64
_SOLD = "order_id bigint, product_id bigint, quantity bigint, sign int, order_date timestamp"


def dated_items(items: DataFrame, orders: DataFrame, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """A stream of items with the dates of their orders, whichever of the two comes first: items (order_id, product_id, quantity,
    sign, ``known_at``) and orders (order_id, order_date, ``known_at``) wait for each other for ``delay`` after they became known. Ids are whole
    numbers. Orders are dealt to ``buckets``, each with one state; their number stays with the checkpoint. Months have no fixed length: with a
    delay in months no row is let go, as in Spark's own joins."""
    types = dict(items.dtypes)
    in_months = re.search("month|quarter|year", delay, re.IGNORECASE)
    at, wait = F.col("known_at").cast("timestamp"), F.expr(f"interval {delay}")
    times = [F.unix_micros(at).alias("at"), F.unix_micros(at - wait).alias("first"), F.unix_micros(at + wait).alias("last")]

    def facts(rows: DataFrame, told, quantity, sign) -> DataFrame:
        timed = rows.withWatermark("known_at", delay).filter("order_id is not null and known_at is not null")
        return timed.select(number("order_id"), *times, told, quantity, sign)

    asked = facts(_signed(items), number("product_id").alias("told"), number("quantity"), number("sign"))
    nothing = F.lit(NONE)
    placed = facts(orders.withColumn("told", F.unix_micros(F.col("order_date").cast("timestamp"))), number("told"), nothing.alias("quantity"), nothing.alias("sign"))
    found = dated(asked, placed, buckets, Dated(leaves=not in_months))
    return found.select(
        missing("order_id").cast(types["order_id"]).alias("order_id"),
        missing("product_id").cast(types["product_id"]).alias("product_id"),
        missing("quantity").alias("quantity"),
        missing("sign").cast("int").alias("sign"),
        F.timestamp_micros(missing("date_us")).alias("order_date"),
    )


def split_late(sold: DataFrame, path: str, checkpoint: str, delay: str) -> StreamingQuery:
    """Append sold items (order_id, product_id, quantity, sign, order_date) to ``path``/late=false or, once the watermark has passed the day
    of their order, to ``path``/late=true."""
    columns = ["order_id", "product_id", "quantity", "sign", "sold_ms"]
    day_end = F.unix_millis(F.date_trunc("day", "order_date")) + 86_400_000
    timed = sold.withWatermark("order_date", delay)
    plain = timed.select(
        number("order_id"), number("product_id"), number("quantity"), F.col("sign").cast("int").alias("sign"),
        F.unix_millis("order_date").alias("sold_ms"), day_end.alias("day_end_ms"), F.pmod(F.hash("order_id"), F.lit(_SPREAD)).alias("bucket"),
    )
    kinds = "order_id bigint, product_id bigint, quantity bigint, sign int, sold_ms bigint, late boolean"
    marked = plain.groupBy("bucket").transformWithStateInPandas(LateSplit(columns), kinds, "append", "eventTime")
    rows = marked.select(
        missing("order_id"), missing("product_id"), missing("quantity"), "sign", F.timestamp_millis("sold_ms").alias("order_date"), "late"
    )
    writer = rows.writeStream.format("parquet").partitionBy("late").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)


def stream_daily_sales(sold: DataFrame, path: str, checkpoint: str, delay: str) -> StreamingQuery:
    """Units per product and day of the order, kept in windows of Spark's own state until the watermark, ``delay`` behind the newest
    order, has passed the day.

    Items that come later than that are set apart first (``late_units``), so that the windows drop none. The windows read all that a batch
    of that step wrote in one batch, and so never see a newer watermark than it did."""
    split = split_late(sold, f"{path}/items", f"{checkpoint}/items", delay)
    split.awaitTermination()
    on_time = file_stream(sold.sparkSession, f"{path}/items", f"{_SOLD}, late boolean", files_per_batch=None).filter("not late")
    windows = on_time.withWatermark("order_date", delay).groupBy("product_id", F.window("order_date", "1 day").alias("day"))
    units = windows.agg(F.sum(F.col("sign") * F.col("quantity")).alias("units"))
    rows = units.select("product_id", F.col("day.start").cast("timestamp_ntz").alias("day"), "units")
    return start(rows, lambda changed, batch: put_batch(changed, f"{path}/days", batch), f"{checkpoint}/days", "update")


def daily_units(spark: SparkSession, path: str) -> DataFrame:
    return newest(stored(spark, f"{path}/days", "product_id bigint, day timestamp_ntz, units bigint"), "product_id", "day")


def late_units(spark: SparkSession, path: str) -> DataFrame:
    """Units per product and day of items that came too late."""
    rows = spark.read.schema(f"{_SOLD}, late boolean").parquet(f"{path}/items").filter("late")
    day = F.date_trunc("day", "order_date").cast("timestamp_ntz").alias("day")
    return rows.groupBy("product_id", day).agg(F.sum(F.col("sign") * F.col("quantity")).cast("bigint").alias("units"))


def monthly_report_from_days(days: DataFrame, tables: Frames) -> DataFrame:
    months = days.groupBy("product_id", F.date_trunc("month", "day").cast("timestamp_ntz").alias("sales_month")).agg(F.sum("units").alias("units"))
    return monthly_report_from_units(months, tables["product"], tables["category"])
