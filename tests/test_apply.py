import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from seed import frame, seed_tables
from tradepost.operators import apply, cascade, promos, quality
from tradepost.sources import TABLES
from tradepost.sources.ingest import ingest

D = Decimal
CODES = "seq bigint, order_id bigint, code string"


@pytest.fixture(scope="module")
def shop(spark):
    return seed_tables(spark)


def status(log):
    return {r.seq: r.status for r in log.collect()}


def priced(shop, cents):
    return shop["order"].withColumn("total_price", F.lit(cents).cast("decimal(10,2)"))


def test_discount_statuses_and_totals(spark, shop):
    requests = frame(spark, [(1, 1, "D1"), (2, 1, "D1"), (3, 2, "D1"), (4, 4, "none"), (5, 4, "D4")], CODES)
    result = promos.apply_discounts(priced(shop, "99.99"), shop["discount_code"], requests)
    assert status(result.log) == {1: "APPLIED", 2: "INACTIVE", 3: "NOT_AVAILABLE", 4: "NOT_AVAILABLE", 5: "APPLIED"}
    totals = {r.order_id: r.total_price for r in result.orders.collect()}
    assert (totals[1], totals[4], totals[2]) == (D("89.99"), D("79.99"), D("99.99"))
    assert not any(r.status for r in result.codes.collect())


def test_used_codes_do_nothing_when_replayed(spark, shop):
    requests = frame(spark, [(1, 1, "D1"), (2, 4, "D4")], CODES)
    once = promos.apply_discounts(priced(shop, "50.00"), shop["discount_code"], requests)
    again = promos.apply_discounts(once.orders, once.codes, requests)
    assert set(status(again.log).values()) == {"INACTIVE"}
    assert sorted(map(tuple, again.orders.collect())) == sorted(map(tuple, once.orders.collect()))


@pytest.mark.parametrize("fold_rows", [1_000_000, 10])
def test_many_codes_of_one_order_round_one_after_another(spark, shop, limits, fold_rows):
    limits.fold_rows = fold_rows
    rng = random.Random(1)
    percents = [D(rng.randint(0, 900)) / 100 for _ in range(45)]
    codes = frame(spark, [(i, f"c{i}", p, True, 1) for i, p in enumerate(percents)], TABLES["discount_code"].schema)
    order = list(range(45))
    rng.shuffle(order)
    requests = frame(spark, [(i, 1, f"c{c}") for i, c in enumerate(order)], CODES)
    result = promos.apply_discounts(priced(shop, "87654.32"), codes, requests)
    total = D("87654.32")
    for c in order:
        total = (total * (1 - percents[c] / 100)).quantize(D("0.01"), "ROUND_HALF_UP")
    assert result.orders.filter("order_id = 1").first().total_price == total


def test_gift_card_may_make_the_total_negative(spark, shop):
    requests = frame(spark, [(1, 1, "G1"), (2, 4, "G4"), (3, 7, "G7"), (4, 7, "G7")], CODES)
    result = promos.apply_gift_cards(priced(shop, "10.00"), shop["gift_card"], requests)
    assert status(result.log) == {1: "APPLIED", 2: "INACTIVE", 3: "APPLIED", 4: "INACTIVE"}
    totals = {r.order_id: r.total_price for r in result.orders.collect()}
    assert (totals[1], totals[4], totals[7]) == (D("-26.72"), D("10.00"), D("-28.84"))


def test_add_products(spark, shop):
    requests = frame(
        spark,
        [(5, "Pen", "1.005", 3, 1), (6, None, "1", 3, 1), (7, "Cup", "x", 3, 1), (8, "Jar", "2", -1, 99), (9, "Lid", "2", None, None)],
        "seq bigint, name string, price string, stock_count int, category_id bigint",
    )
    changed, log = apply.add_products(shop, requests)
    assert status(log) == {
        5: "DONE", 6: "not_null:name", 7: "type:price", 8: "check:stock_not_negative,foreign_key:category_id", 9: "DONE",
    }
    new = {r.product_id: r for r in changed["product"].filter("product_id > 20").collect()}
    assert (new[21].name, new[21].price, new[21].rating) == ("Pen", D("1.01"), 0)
    assert (new[22].name, new[22].stock_count) == ("Lid", None)


def test_register_customers(spark, shop):
    requests = frame(
        spark,
        [(1, None, "B", "new", None), (2, "A", "B", "new", ["1"]), (3, "A", "C", "new", None), (4, "A", "B", "user3", None)],
        "seq bigint, first_name string, last_name string, username string, phone_numbers array<string>",
    )
    changed, log = apply.register_customers(shop, requests)
    assert status(log) == {1: "not_null:first_name", 2: "DONE", 3: "unique:username", 4: "unique:username"}
    row = changed["customer"].filter("username = 'new'").first()
    assert (row.customer_id, row.wallet_balance, row.phone_numbers) == (26, 0, ["1"])


def test_phone_numbers(spark, shop):
    t = shop.replace(customer=shop["customer"].withColumn("phone_numbers", F.when(F.col("customer_id") != 2, F.col("phone_numbers"))))
    requests = frame(spark, [(2, 1, "b"), (1, 1, "a"), (3, 2, "c"), (4, 99, "d")], "seq bigint, customer_id bigint, phone string")
    phones, log = apply.add_phone_numbers(t, requests)
    assert status(log) == {1: "DONE", 2: "DONE", 3: "DONE", 4: "UNKNOWN_CUSTOMER"}
    arrays = {r.customer_id: r.phone_numbers for r in apply.phone_arrays(t["customer"], phones).collect()}
    assert (arrays[1], arrays[2], arrays[3]) == (["1-1", "a", "b"], ["c"], ["3-1"])


def test_update_customers(spark, shop):
    requests = frame(
        spark,
        [(1, "user1", "X", None, None), (2, "user1", None, "Y", []), (3, "user1", "Z", None, None), (4, "user2", None, None, None), (5, "who", "Q", None, None)],
        "seq bigint, username string, first_name string, last_name string, phone_numbers array<string>",
    )
    changed, log = apply.update_customers(shop, requests)
    assert status(log) == {1: "DONE", 2: "DONE", 3: "DONE", 4: "NO_FIELDS", 5: "UNKNOWN_CUSTOMER"}
    row = changed["customer"].filter("customer_id = 1").first()
    assert (row.first_name, row.last_name, row.phone_numbers) == ("Z", "Y", [])
    assert changed["customer"].count() == 25


def test_add_to_favorites(spark, shop):
    t = shop.replace(product=shop["product"].withColumn("stock_count", F.when(F.col("product_id") != 4, F.col("stock_count"))))
    requests = frame(
        spark,
        [(1, 2, 1, 15), (2, 2, 1, 5), (3, 15, 1, 4), (4, 2, 99, 1), (5, 99, 1, 1), (6, 3, 3, 4), (7, 5, 4, 1000), (8, 2, 2, None)],
        "seq bigint, customer_id bigint, product_id bigint, quantity int",
    )
    changed, log = apply.add_to_favorites(t, requests, "2024-12-01")
    assert status(log) == {
        1: "DONE", 2: "EXCEEDS_STOCK", 3: "DONE", 4: "UNKNOWN_PRODUCT", 5: "UNKNOWN_CUSTOMER", 6: "EXCEEDS_STOCK", 7: "DONE", 8: "NO_QUANTITY",
    }
    lists = {r.customer_id: r for r in changed["favorite_list"].collect()}
    assert len(lists) == 15 and (lists[2].favorite_id, lists[5].favorite_id) == (14, 15) and 3 not in lists
    assert lists[2].total_price == D("1150.35") and lists[15].total_price == D("3522.48") and lists[24].total_price == 0
    items = {(r.favorite_id, r.product_id): r.quantity for r in changed["favorite_list_items"].collect()}
    assert (items[14, 1], items[1, 1], items[15, 4], len(items)) == (15, 30, 1000, 15)
    stock = {r.product_id: r.stock_count for r in changed["product"].collect()}
    assert (stock[1], stock[3], stock[4]) == (0, 3, None)


def test_create_orders(spark, shop):
    requests = frame(
        spark,
        [
            (1, 13, 9, [1, 3], [4, 100]),
            (2, 13, 9, [1, 1], [1, 1]),
            (3, 13, 8, [1], [1]),
            (4, 13, 9, [1, 2], [1]),
            (5, 13, 9, [], []),
            (6, 13, 9, [1, 99], [1, 1]),
            (7, 6, 8, [3], [50]),
            (8, 6, 8, [1], [15]),
            (9, 6, 8, [1], [1]),
            (10, 6, 8, [1], [None]),
            (11, 6, 8, None, [1]),
        ],
        "seq bigint, customer_id bigint, address_id bigint, product_ids array<bigint>, quantities array<int>",
    )
    changed, log = apply.create_orders(shop, requests, "2024-12-01")
    got = {(r.seq, r.product_id): r.status for r in log.collect()}
    assert got == {
        (1, 1): "DONE", (1, 3): "EXCEEDS_STOCK", (2, None): "PRODUCT_TWICE", (3, None): "ADDRESS_NOT_OF_CUSTOMER",
        (4, None): "INCORRECT_INPUT", (5, None): "INCORRECT_INPUT", (6, None): "UNKNOWN_PRODUCT", (7, 3): "EXCEEDS_STOCK",
        (8, 1): "DONE", (9, 1): "EXCEEDS_STOCK", (10, None): "NO_QUANTITY", (11, None): "INCORRECT_INPUT",
    }
    new = {r.order_id: (r.customer_id, r.total_price) for r in changed["order"].filter("order_id > 8").collect()}
    assert new == {9: (13, D("306.76")), 10: (6, D("0.00")), 11: (6, D("1150.35")), 12: (6, D("0.00"))}
    assert changed["order_items"].count() == 22
    assert changed["product"].filter("product_id = 1").first().stock_count == 0


def test_cascade_leaves_no_orphans(spark, shop):
    names = frame(spark, [("user6",), ("user17",)], "username string")
    left = cascade.delete_customers(shop, names)
    after = shop.replace(**left)
    assert quality.dq_foreign_keys(after).filter("violations > 0").count() == 0
    assert {r.order_id for r in left["order"].collect()} == {1, 4, 5, 6, 7}
    assert left["customer"].count() == 23 and "product" not in left
    # A payment goes with its order, whoever paid.
    assert {r.payment_id for r in left["payment"].collect()} == {1, 4, 6, 7, 8}


def test_deleting_a_category_takes_products_and_items(spark, shop):
    left = cascade.cascade_delete(shop, "category", frame(spark, [(1,)], "category_id bigint"))
    assert {r.product_id for r in left["product"].collect()} == set(range(1, 21)) - {1, 6, 19}
    assert left["order_items"].filter("product_id in (1, 6, 19)").count() == 0
    assert left["review"].count() == 8


def test_ingest_rounds_defaults_and_rejects(spark):
    raw = frame(
        spark,
        [(1, "2.3", "a", 1, 1), (2, "2.87", None, 1, 1), (3, "5.5", "a", 1, 1), (4, None, None, 1, 1), (5, "2.5", "b", None, 1)],
        "seq bigint, rating string, comment string, customer_id bigint, product_id bigint",
    )
    ok, bad = ingest(raw, TABLES["review"])
    assert {(r.review_id, r.seq, r.rating) for r in ok.collect()} == {(1, 1, 2), (2, 2, 3)}
    assert {r.seq: r.reasons for r in bad.collect()} == {
        3: ["check:rating_1_to_5"], 4: ["check:comment_or_rating"], 5: ["not_null:customer_id"],
    }


def test_row_refused_for_one_key_does_not_hold_its_other_key(spark):
    raw = frame(
        spark,
        [(1, 10, "a"), (2, 11, "a"), (3, 11, "b"), (4, 12, "b"), (5, 12, "c")],
        "seq bigint, discount_id bigint, code string",
    ).select("*", F.lit(5).alias("percentage"), F.lit(True).alias("status"), F.lit(1).alias("order_id"))
    ok, bad = ingest(raw, TABLES["discount_code"])
    assert sorted(r.seq for r in ok.collect()) == [1, 3, 5]
    assert {r.seq: r.reasons for r in bad.collect()} == {2: ["unique:code"], 4: ["unique:code"]}


def test_quality_finds_each_kind_of_fault(spark, shop):
    bad = shop.replace(
        review=shop["review"].withColumn("rating", F.lit(9)).withColumn("product_id", F.lit(77).cast("bigint")),
        customer=shop["customer"].withColumn("username", F.lit("x" * 31)).withColumn("last_name", F.lit(None).cast("string")),
    )
    found = {(r.table_name, r.rule): r.violations for r in quality.quality_report(bad).filter("violations > 0").collect()}
    assert found == {
        ("review", "check:rating_1_to_5"): 10,
        ("review", "foreign_key:product_id->product"): 10,
        ("customer", "length:username"): 25,
        ("customer", "not_null:last_name"): 25,
        ("customer", "unique:username"): 24,
    }
    keys = quality.violating_keys(bad).groupBy("rule").count().collect()
    assert {r.rule: r["count"] for r in keys}["foreign_key:product_id->product"] == 1
