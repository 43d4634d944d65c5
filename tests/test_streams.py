"""A stream over files that arrive one after another ends where one batch over all rows does."""

import glob
import os
import random
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from seed import NOW, frame, seed_tables
from test_stock import greedy
from test_wallet import example, ledger
from test_wallet import tables as wallet_tables
from tradepost.operators import derive, sales
from tradepost.streaming import jobs
from tradepost.streaming.runner import append_to, file_stream, finish
from tradepost.streaming.stateful import NONE, _squeezed, _unsqueezed

D = Decimal


@pytest.fixture(scope="module")
def shop(spark):
    return seed_tables(spark)


def arrive(spark, folder, *batches):
    """Write each batch as one file; the stream takes one file per micro-batch, in this order."""
    source = f"{folder}/in"
    os.makedirs(source, exist_ok=True)
    for df in batches:
        i = len(os.listdir(source))
        df.coalesce(1).write.parquet(f"{folder}/in{i}")
        os.rename(glob.glob(f"{folder}/in{i}/*.parquet")[0], f"{source}/{i}.parquet")
        os.utime(f"{source}/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return file_stream(spark, source, batches[0].schema, files_per_batch=1)


def rows(df):
    return sorted(map(str, df.collect()))


def signed(df, sign):
    return df.withColumn("sign", F.lit(sign))


def test_order_totals(spark, shop, folder):
    items = shop["order_items"]
    first, second = items.filter("order_id < 4"), items.filter("order_id >= 3")
    gone = items.filter("order_id = 3")
    stream = arrive(spark, folder, signed(first, 1), signed(second, 1), signed(gone, -1))
    finish(jobs.stream_totals(stream, lambda: shop, "order_id", f"{folder}/out", f"{folder}/cp"))
    assert rows(jobs.with_totals(shop["order"], shop["product"], f"{folder}/out", "order_id")) == rows(derive.order_totals(shop))


def test_items_of_products_that_come_later(spark, shop, folder):
    early = shop.replace(product=shop["product"].filter("product_id > 9"))
    stream = arrive(spark, folder, shop["order_items"])
    finish(jobs.stream_totals(stream, lambda: early, "order_id", f"{folder}/out", f"{folder}/cp"))
    for now in (early, shop):
        got = jobs.with_totals(shop["order"], now["product"], f"{folder}/out", "order_id")
        # While a product is not known its items are not counted, as in the batch job; nothing is lost once it is.
        assert rows(got) == rows(derive.order_totals(now))


def test_totals_before_any_batch(spark, shop, folder):
    got = jobs.with_totals(shop["order"], shop["product"], f"{folder}/none", "order_id")
    assert rows(got) == rows(shop["order"].withColumn("total_price", F.col("total_price").cast("decimal(18,2)")))


def test_emptied_favorite_list(spark, shop, folder):
    items = shop["favorite_list_items"]
    stream = arrive(spark, folder, signed(items, 1), signed(items.filter("favorite_id = 8"), -1))
    finish(jobs.stream_totals(stream, lambda: shop, "favorite_id", f"{folder}/out", f"{folder}/cp"))
    left = shop.replace(favorite_list_items=items.filter("favorite_id <> 8"))
    got = jobs.with_totals(shop["favorite_list"], shop["product"], f"{folder}/out", "favorite_id")
    assert rows(got) == rows(derive.favorite_totals(left))


def test_product_ratings(spark, shop, folder):
    review = shop["review"]
    stream = arrive(spark, folder, signed(review, 1), signed(review.filter("product_id in (1, 10)"), -1))
    finish(jobs.stream_product_ratings(stream, f"{folder}/out", f"{folder}/cp"))
    got = {r.product_id: r.rating for r in jobs.ratings(spark, f"{folder}/out").collect()}
    assert got == {12: None, 10: None, 14: 2, 20: None, 1: None, 19: 3, 8: None, 7: 3}


def entries(query):
    """Rows in the state store after each batch that had a state."""
    return [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]


def judged_by(spark, folder, parts, delay):
    stream = arrive(spark, folder, *parts)
    query = jobs.stream_stock_gate(stream, f"{folder}/out", f"{folder}/cp", delay)
    finish(query)
    return query, spark.read.parquet(f"{folder}/out").collect()


def gate_events(spark, requests, stock, upto=10**6):
    asked = frame(spark, requests, "seq bigint, product_id bigint, quantity int").withColumn("time", F.timestamp_seconds("seq"))
    goods = frame(spark, stock, "product_id bigint, stock_count int")
    events = jobs.stock_events(asked, goods, "time", F.timestamp_seconds(F.lit(0)))
    return events, jobs.clock_event(events, "product_id", F.timestamp_seconds(F.lit(upto)))


def test_stock_gate_in_any_order_within_the_delay(spark, folder):
    rng = random.Random(11)
    requests = [(i, 1 if i % 3 == 0 else rng.randint(2, 5), rng.randint(1, 20)) for i in range(1, 150)]
    stock = {1: 200, 2: 90, 3: 10**6, 4: 0, 5: 55}
    events, end = gate_events(spark, requests, list(stock.items()))
    shuffled = F.when(F.col("kind") == "stock", 0).otherwise((F.col("id") / 50).cast("int") + F.when(F.col("id") % 4 == 0, 1).otherwise(0))
    parts = [events.filter(shuffled == i) for i in range(4)] + [end]
    query, judged = judged_by(spark, folder, parts, "60 seconds")
    taken, left = greedy(requests, stock)
    assert {(r.seq, r.product_id): r.accepted for r in judged} == taken and not any(r.late for r in judged)
    last = {r.product_id: r.stock_left for r in sorted(judged, key=lambda r: r.seq)}
    assert {**stock, **last} == left
    held = entries(query)
    assert held[-1] <= len(stock) + 1 < max(held)  # nothing waits at the end


def test_products_share_the_state_of_their_bucket(spark, folder):
    rng = random.Random(5)
    requests = [(i, rng.randint(1, 300), rng.randint(1, 9)) for i in range(1, 1200)]
    stock = {p: rng.randint(0, 30) for p in range(1, 301)}
    events, end = gate_events(spark, requests, list(stock.items()))
    stream = arrive(spark, folder, events, end)
    query = jobs.stream_stock_gate(stream, f"{folder}/out", f"{folder}/cp", "2000 seconds", buckets=4)
    finish(query)
    judged = spark.read.parquet(f"{folder}/out").collect()
    assert {(r.seq, r.product_id): r.accepted for r in judged} == greedy(requests, stock)[0]
    assert max(entries(query)) <= 4 * 6  # and not some for each of 300 products


def test_late_requests_are_judged_and_marked(spark, folder):
    events, end = gate_events(spark, [(10, 1, 3), (100, 1, 3), (50, 1, 4), (5, 1, 2)], [(1, 8)])
    one = lambda *ids: events.filter(((F.col("kind") == "stock") & F.lit(10 in ids)) | ((F.col("kind") == "row") & F.col("id").isin(*ids)))
    _, judged = judged_by(spark, folder, [one(10), one(100), one(50, 5), end], "20 seconds")
    got = {r.seq: (r.accepted, r.late) for r in judged}
    assert got == {10: (True, False), 5: (True, True), 50: (False, True), 100: (True, False)}


def test_requests_that_name_nothing_get_a_row(spark, folder):
    requests = [(1, 1, 3), (2, 99, 1), (3, None, 1), (4, 1, None), (5, 1, 3), (6, 1, 2), (7, 2, 10**6)]
    events, end = gate_events(spark, requests, [(1, 5), (2, None)])
    _, judged = judged_by(spark, folder, [events, end], "1 second")
    assert {r.seq: (r.accepted, r.status) for r in judged} == {
        1: (True, "DONE"), 2: (False, "UNKNOWN_PRODUCT"), 3: (False, "NO_PRODUCT"), 4: (False, "NO_QUANTITY"), 5: (False, "EXCEEDS_STOCK"),
        6: (True, "DONE"), 7: (True, "DONE"),
    }
    assert {r.seq: (r.product_id, r.quantity) for r in judged} == {s: (p, q) for s, p, q in requests}


def wallet_stream(spark, folder, payments, orders, wallets, part, delay, keep="365 days", accounts=None):
    t = wallet_tables(spark, payments, orders, wallets)
    placed = t["order"].withColumn("order_date", F.lit(NOW).cast("timestamp_ntz"))
    if "customer_id" not in placed.columns:
        placed = placed.withColumn("customer_id", F.lit(1).cast("bigint"))
    events = jobs.wallet_events(t["payment"], placed, t["customer"], F.lit(NOW), accounts)
    end = jobs.clock_event(events, "account", F.lit(NOW + timedelta(days=9999)))
    first = events.filter("kind <> 'row'")
    parts = [events.filter((F.col("kind") == "row") & (part == i)) for i in range(3)]
    stream = arrive(spark, folder, parts[0].unionByName(first), parts[1], parts[2], end)
    query = jobs.stream_wallet_ledger(stream, f"{folder}/out", f"{folder}/cp", delay, keep)
    finish(query)
    return query, spark.read.parquet(f"{folder}/out").collect()


def test_wallet_ledger(spark, folder):
    payments, orders, wallets = example(21, n=90)
    payments = [(p, NOW + timedelta(minutes=p), c, o, a) for p, _, c, o, a in payments]
    accounts = frame(spark, [(c, 1) for c in wallets], "customer_id bigint, account bigint")
    part = (F.col("id") / 30).cast("int") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)
    query, got = wallet_stream(spark, folder, payments, orders, wallets, F.least(part, F.lit(2)), "2 hours", accounts=accounts)
    cents = lambda x: int(x * 100)
    told = {r.payment_id: (r.order_paid, cents(r.stored_amount), cents(r.paid_sum), cents(r.wallet_after)) for r in got}
    assert told == ledger(payments, orders, wallets)[0]
    assert not any(r.late for r in got)


def test_paid_orders_leave_the_state(spark, folder):
    at = lambda days: datetime(2024, 1, 1) + timedelta(days=days)
    schema = "account bigint, kind string, at timestamp, id bigint, customer_id bigint, order_id bigint, cents bigint"
    start = [(1, "wallet", at(0), 0, 1, 0, 0)] + [(1, "order", at(0), 0, 1, o, 1000) for o in (1, 2, 3)]
    paid = [(1, "row", at(1), 11, 1, 1, 1000), (1, "row", at(1), 12, 1, 2, 400)]
    again = [(1, "row", at(3), 13, 1, 1, 700)]  # a paid order is paid for once more within the time it is kept
    much_later = [(1, "row", at(40), 14, 1, 1, 500), (1, "row", at(40), 15, 1, 2, 600), (1, "row", at(40), 16, 1, 3, 1000)]
    clock = [(None, "clock", at(900), 0, 0, 0, 0)]
    batches = [frame(spark, x, schema) for x in (start + paid, again, much_later, clock)]
    query = jobs.stream_wallet_ledger(arrive(spark, folder, *batches), f"{folder}/out", f"{folder}/cp", "1 day", "7 days")
    finish(query)
    got = {r.payment_id: r for r in spark.read.parquet(f"{folder}/out").collect()}
    assert [got[p].status for p in (11, 12, 13, 14, 15, 16)] == ["PAID", "OPEN", "PAID", "UNKNOWN_ORDER", "PAID", "PAID"]
    assert (got[13].paid_sum, got[13].wallet_after) == (17, 7)  # the sum went on, the excess is in the wallet
    held = entries(query)
    assert held[-1] == 1 < max(held)  # the wallet is all that is left


def test_accounts_share_the_state_of_their_bucket(spark, folder):
    schema = "account bigint, kind string, at timestamp, id bigint, customer_id bigint, order_id bigint, cents bigint"
    day = datetime(2024, 1, 1)
    # Orders of one number in every account; a payment meets its own account's order and wallet only.
    facts = [x for a in range(200) for x in ((a, "wallet", day, 0, 7, 0, 100 * a), (a, "order", day, 0, 7, 1, 10050))]
    paid = [(a, "row", day + timedelta(hours=1 + a % 3), a, 7, 1, 5000) for a in range(200)]
    stream = arrive(spark, folder, frame(spark, facts + paid, schema), frame(spark, [(None, "clock", day + timedelta(days=99), 0, 0, 0, 0)], schema))
    query = jobs.stream_wallet_ledger(stream, f"{folder}/out", f"{folder}/cp", "1 day", buckets=4)
    finish(query)
    got = {r.payment_id: (r.order_paid, r.wallet_after) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {a: (a > 50, D(100 * a - 5050) / 100 if a > 50 else D(0)) for a in range(200)}
    assert max(entries(query)) <= 4 * 7  # and not some for each of 200 accounts


def test_a_payment_before_its_order(spark, folder):
    schema = "account bigint, kind string, at timestamp, id bigint, customer_id bigint, order_id bigint, cents bigint"
    at = lambda hours: datetime(2024, 1, 1) + timedelta(hours=hours)
    early = [(1, "wallet", at(0), 0, 1, 0, 0), (1, "row", at(5), 11, 1, 1, 1000), (1, "row", at(6), 12, 1, 2, 5)]
    order = [(1, "order", at(1), 0, 1, 1, 1000)]
    batches = [frame(spark, x, schema) for x in (early, order, [(None, "clock", at(900), 0, 0, 0, 0)])]
    finish(jobs.stream_wallet_ledger(arrive(spark, folder, *batches), f"{folder}/out", f"{folder}/cp", "10 hours"))
    got = {r.payment_id: (r.status, r.stored_amount) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {11: ("PAID", D(10)), 12: ("UNKNOWN_ORDER", D("0.05"))}


def test_order_addresses(spark, shop, folder):
    orders = shop["order"].withColumn("address_id", F.lit(8).cast("bigint"))
    stream = arrive(spark, folder, orders.filter("order_id <= 4"), orders.filter("order_id > 4"))
    finish(jobs.stream_order_address_check(stream, lambda: shop, f"{folder}/out", f"{folder}/cp"))
    got = spark.read.parquet(f"{folder}/out").drop("batch")
    assert rows(got) == rows(derive.check_order_addresses(orders, shop["address"]).select(*got.columns))


def test_notices(spark, shop, folder):
    stream = arrive(spark, folder, shop["review"])
    finish(jobs.stream_review_notifications(stream, f"{folder}/out", f"{folder}/cp"))
    assert rows(spark.read.parquet(f"{folder}/out")) == rows(derive.review_notifications(shop["review"]))


def test_history(spark, shop, folder):
    paid = [frame(spark, x, "order_id bigint") for x in ([(1,), (7,)], [(7,), (8,)])]
    stream = arrive(spark, folder, *paid)
    finish(jobs.stream_order_history(stream, lambda: shop, f"{folder}/out", f"{folder}/cp"))
    log = jobs.history(spark, f"{folder}/out").collect()
    assert sorted((r.log_id, r.order_id) for r in log) == [(1, 1), (2, 7), (3, 7), (4, 8)]


def test_history_logs_once_within_the_watermark(spark, shop, folder):
    at = lambda days: datetime(2024, 1, 1) + timedelta(days=days)
    schema = "order_id bigint, paid_at timestamp"
    paid = [frame(spark, x, schema) for x in ([(1, at(0)), (7, at(1))], [(7, at(2)), (8, at(3))], [(2, at(60))], [(7, at(61)), (2, at(62))])]
    held = []
    for some in paid:
        query = jobs.stream_order_history(arrive(spark, folder, some), lambda: shop, f"{folder}/out", f"{folder}/cp", "10 days")
        finish(query)
        held += entries(query)
    log = jobs.history(spark, f"{folder}/out").collect()
    # 7 is logged again two months later; the orders of January have left the state.
    assert sorted((r.log_id, r.order_id) for r in log) == [(1, 1), (2, 7), (3, 8), (4, 2), (5, 7)]
    assert held[-1] <= 2 < max(held) <= 4


def sold_items(shop):
    moved = shop.replace(order=shop["order"].withColumn("order_date", F.expr("order_date + make_dt_interval(order_id * 9)")))
    dates = moved["order"].select("order_id", F.col("order_date").cast("timestamp").alias("order_date"))
    items = shop["order_items"].join(dates, "order_id").withColumn("sign", F.lit(1))
    return moved, items.select("order_id", "product_id", F.col("quantity").cast("bigint").alias("quantity"), "sign", "order_date")


def test_daily_sales(spark, shop, folder):
    moved, items = sold_items(shop)
    stream = arrive(spark, folder, items.filter("order_id > 5"), items.filter("order_id <= 5"), items.limit(0))
    finish(jobs.stream_daily_sales(stream, f"{folder}/out", f"{folder}/cp", "1000 days"))
    assert jobs.late_units(spark, f"{folder}/out").isEmpty()
    got = jobs.monthly_report_from_days(jobs.daily_units(spark, f"{folder}/out"), moved)
    assert rows(got) == rows(sales.monthly_report(moved))


def test_late_items_are_set_apart(spark, shop, folder):
    moved, items = sold_items(shop)
    last = items.agg(F.max("order_date")).first()[0]
    far = frame(spark, [(99, 1, 0, 1, last + timedelta(days=500))], items.schema)
    held = []
    for some in (items.filter("order_id > 5"), items.filter("order_id <= 5"), far):
        stream = arrive(spark, folder, some)
        query = jobs.stream_daily_sales(stream, f"{folder}/out", f"{folder}/cp", "20 days")
        finish(query)
        held += entries(query)
    days, late = jobs.daily_units(spark, f"{folder}/out"), jobs.late_units(spark, f"{folder}/out")
    assert late.count() > 0
    assert days.unionByName(late).agg(F.sum("units")).first()[0] == items.agg(F.sum("quantity")).first()[0]
    early = {r.order_id for r in moved["order"].collect() if r.order_id <= 5 and r.order_date.date() < (last - timedelta(days=20)).date()}
    want = items.filter(F.col("order_id").isin(*early)).agg(F.sum("quantity")).first()[0]
    assert late.agg(F.sum("units")).first()[0] == want
    assert held[-1] == 1 < max(held)  # only the window of the last day is left behind the watermark


def test_items_wait_for_their_orders(spark, shop, folder):
    _, items = sold_items(shop)
    schema = "order_id bigint, product_id bigint, quantity bigint, sign int, order_date timestamp, known_at timestamp"
    known = items.withColumn("known_at", F.timestamp_seconds(F.col("order_id") + 10**9)).select(*[c.split()[0] for c in schema.split(", ")])
    asked = known.withColumn("order_date", F.lit(None).cast("timestamp"))
    placed = known.select("order_id", "order_date", "known_at").distinct()
    whole = asked.unionByName(placed, allowMissingColumns=True)
    orders = F.col("product_id").isNull()
    stream = arrive(spark, folder, whole.filter(~orders & F.lit(True)), whole.filter(orders))
    a, b = stream.filter("product_id is not null").drop("order_date"), stream.filter("product_id is null")
    finish(append_to(jobs.dated_items(a, b, "1 hour"), f"{folder}/out", f"{folder}/cp"))
    assert rows(spark.read.parquet(f"{folder}/out").select(items.columns)) == rows(items)


KNOWN = "order_id bigint, product_id bigint, quantity bigint, sign int, order_date timestamp, known_at timestamp"


def dated(stream, delay):
    return jobs.dated_items(stream.filter("product_id is not null").drop("order_date"), stream.filter("product_id is null"), delay)


def wanted(all_rows):
    items, orders = all_rows.filter("product_id is not null").drop("order_date"), all_rows.filter("product_id is null").select("order_id", "order_date")
    return rows(items.join(orders, "order_id").select("order_id", "product_id", "quantity", "sign", "order_date"))


def test_waiting_items_are_held_in_few_entries(spark, folder):
    at = F.timestamp_seconds(F.col("order_id") + 10**9).alias("known_at")
    order = (F.col("id") % 600).alias("order_id")
    items = spark.range(12000).select(order, (F.col("id") + 1).alias("product_id"), F.lit(2).cast("bigint").alias("quantity"), F.lit(1).alias("sign"))
    items = items.select("*", F.lit(None).cast("timestamp").alias("order_date"), at)
    orders = spark.range(500).select(F.col("id").alias("order_id"), F.timestamp_seconds("id").alias("order_date")).select("*", at)
    whole = items.unionByName(orders, allowMissingColumns=True)
    parts = [whole.filter(x) for x in ("product_id % 3 = 0 or order_id % 2 = 0 and product_id is null", "product_id % 3 = 1", "product_id % 3 = 2 or order_id % 2 = 1 and product_id is null")]
    query = append_to(dated(arrive(spark, folder, *parts), "1 hour"), f"{folder}/out", f"{folder}/cp")
    finish(query)
    assert rows(spark.read.parquet(f"{folder}/out")) == wanted(whole)
    assert max(entries(query)) < 6 * 512  # 12,500 rows wait


def test_waiting_rows_are_compared_in_pieces(spark, folder, monkeypatch):
    """One order holds most rows, and a bucket is compared and held 50 rows at a time."""
    make = jobs.Dated
    monkeypatch.setattr(jobs, "Dated", lambda **how: make(50, **how))
    draw = random.Random(4)
    made = []
    for _ in range(900):
        order, at = draw.choice([7, 7, 7, draw.randrange(40), None]), datetime(2020, 1, 1) + timedelta(seconds=draw.randrange(600))
        is_item = draw.random() < 0.8
        made.append((order, draw.randrange(9) if is_item else None, draw.choice([None, 5, -2]), draw.choice([1, -1]), None if is_item or draw.random() < 0.1 else at, None if draw.random() < 0.02 else at))
    parts = [spark.createDataFrame(made[i : i + 300], KNOWN) for i in (0, 300, 600)]
    for some in parts:
        finish(append_to(dated(arrive(spark, folder, some), "1 hour"), f"{folder}/out", f"{folder}/cp"))
    assert rows(spark.read.parquet(f"{folder}/out")) == wanted(spark.createDataFrame(made, KNOWN).filter("known_at is not null"))


def test_rows_wait_no_longer_than_the_delay(spark, folder):
    day = datetime(2020, 1, 1)

    def both(*rows_):
        return spark.createDataFrame([(o, p, 1, 1, None if p else day, day + timedelta(minutes=m)) for o, p, m in rows_], KNOWN)

    held = []
    for some in (
        both((1, 5, 0), (2, 6, 0), (2, None, 10)),  # order 1 does not come in time
        both((3, 7, 119), (3, None, 121), (2, 8, 119)),  # product 8 comes too long after order 2 to be its item
        both((8, 9, 60 * 24), (8, None, 60 * 24)),
        both((1, None, 30), (3, 4, 120), (9, 9, 60 * 25), (9, None, 60 * 25)),  # behind the watermark
    ):
        query = append_to(dated(arrive(spark, folder, some), "1 hour"), f"{folder}/out", f"{folder}/cp")
        finish(query)
        held.append(spark.read.format("statestore").option("stateVarName", "chunks").load(f"{folder}/cp").count())
    assert sorted((r.order_id, r.product_id) for r in spark.read.parquet(f"{folder}/out").collect()) == [(2, 6), (3, 7), (8, 9), (9, 9)]
    assert held[2] == 2  # only the rows of order 8


def test_numbers_of_held_rows_are_kept_exactly():
    top = np.iinfo("int64").max
    for held in ([[5, 5, 5]] * 7, [[-top - 1, top, 0]] * 7, [[0, 1, 2], [9, 300, 70000], [8, 299, 69999], [top, 1, -5], [NONE, 4, 2], [7, 7, 7], [1, -1, 1 << 32]]):
        held = np.array(held, dtype="int64")
        assert (_unsqueezed(_squeezed(held)) == held).all()


def test_parts_are_made_once(spark, folder):
    from checks.streams import _in_parts

    drawn = F.udf(lambda _: random.randint(0, 3), "int").asNondeterministic()
    start = lambda rows: append_to(rows, f"{folder}/out", f"{folder}/cp")
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    _in_parts(spark, spark.range(3000).select("id", drawn("id").alias("part")).filter("part <> 1"), 3, start, [spark.range(3000, 3002)])
    assert sorted(r.id for r in spark.read.parquet(f"{folder}/out").collect() if r.id >= 3000) == [3000, 3001]
    seen = [r.id for r in spark.read.parquet(f"{folder}/out").collect()]
    assert len(seen) == len(set(seen)) and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_repeated_batch_changes_nothing(spark, shop, folder):
    stream = arrive(spark, folder, shop["order_items"])
    for run in range(2):
        # A lost checkpoint makes the stream start over; a batch then replaces what it held.
        finish(jobs.stream_totals(stream, lambda: shop, "order_id", f"{folder}/out", f"{folder}/cp{run}"))
    assert rows(jobs.with_totals(shop["order"], shop["product"], f"{folder}/out", "order_id")) == rows(derive.order_totals(shop))


def test_arriving_rows_are_made_once(spark, folder):
    from checks.streams import _arriving

    drawn = F.udf(lambda _: random.randint(0, 10**6), "bigint").asNondeterministic()
    rows_ = spark.range(3000).select("id", drawn("id").alias("key"))
    start = lambda rows: append_to(rows, f"{folder}/out", f"{folder}/cp")
    _arriving(spark, rows_, F.col("key"), start)
    # Drawn anew for each third, some rows would come twice or not at all.
    assert sorted(r.id for r in spark.read.parquet(f"{folder}/out").collect()) == list(range(3000))
