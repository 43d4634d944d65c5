"""Answers worked out by hand for the example shop, with all requests kept (raw) and with stock limits
applied to the order items in arrival order (gated)."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from seed import ITEMS, frame, seed_tables
from tradepost.operators import customers, derive, quality, reviews, sales
from tradepost.operators.stock import allocate_stock, remaining_stock
from tradepost.operators.wallet import wallet_ledger

D = Decimal


@pytest.fixture(scope="module")
def raw(spark):
    return seed_tables(spark)


@pytest.fixture(scope="module")
def gated(spark, raw):
    """Items that the stock allows, with the stock, order totals and ratings that follow."""
    arrivals = [(i, *map(int, x.split(","))) for i, x in enumerate(ITEMS)]
    wanted = frame(spark, arrivals, "seq bigint, quantity int, product_id bigint, order_id bigint")
    judged = allocate_stock(wanted, raw["product"])
    kept = judged.filter("accepted").select("quantity", "order_id", "product_id")
    t = raw.replace(order_items=kept, product=remaining_stock(judged, raw["product"]))
    totals = derive.order_totals(t).withColumn("total_price", F.col("total_price").cast("decimal(10,2)"))
    return t.replace(order=totals)


def as_dict(df, key, *values):
    return {r[key]: (r[values[0]] if len(values) == 1 else tuple(r[v] for v in values)) for r in df.collect()}


def test_stock_gate(gated):
    kept = {(r.quantity, r.product_id, r.order_id) for r in gated["order_items"].collect()}
    assert kept == {(2, 17, 1), (3, 14, 6), (10, 9, 1), (8, 10, 3), (5, 2, 7), (4, 18, 8), (5, 12, 2), (2, 9, 4), (1, 8, 5)}
    left = as_dict(gated["product"], "product_id", "stock_count")
    changed = {2: 5, 8: 13, 9: 3, 10: 9, 12: 4, 14: 2, 17: 5, 18: 15}
    assert {p: left[p] for p in changed} == changed
    assert left[1] == 19 and left[3] == 3


def test_order_totals(raw, gated):
    assert as_dict(derive.order_totals(raw), "order_id", "total_price") == {
        1: D("2659.22"), 2: D("884.31"), 3: D("1140.39"), 4: D("1349.26"), 5: D("1074.28"), 6: D("127.05"), 7: D("3325.21"), 8: D("54.40"),
    }
    assert as_dict(gated["order"], "order_id", "total_price") == {
        1: D("302.54"), 2: D("471.15"), 3: D("589.84"), 4: D("45.14"), 5: D("82.08"), 6: D("127.05"), 7: D("451.00"), 8: D("54.40"),
    }


def test_order_totals_of_some_orders(spark, raw):
    touched = frame(spark, [(8,)], "order_id bigint")
    totals = as_dict(derive.order_totals(raw, touched), "order_id", "total_price")
    assert totals[8] == D("54.40") and totals[1] == 0


def test_favorite_totals(raw):
    totals = as_dict(derive.favorite_totals(raw), "favorite_id", "total_price")
    expected = {1: "3215.72", 3: "244.20", 7: "854.00", 8: "1351.80", 9: "1568.98", 10: "1466.55", 12: "1309.05", 13: "811.03"}
    assert totals == {i: D(expected.get(i, "0.00")) for i in range(1, 14)}


def test_product_ratings(raw):
    ratings = as_dict(derive.product_ratings(raw), "product_id", "rating")
    changed = {1: D(2), 7: D(3), 10: D(4), 14: D(2), 19: D(3), 8: None, 12: None, 20: None}
    assert ratings == {i: changed.get(i, D("0.00")) if i in changed else D("0.00") for i in range(1, 21)}


def test_product_whose_reviews_are_gone(spark, raw):
    touched = frame(spark, [(2,), (1,)], "product_id bigint")
    ratings = as_dict(derive.product_ratings(raw, touched), "product_id", "rating")
    assert ratings[2] is None and ratings[1] == 2 and ratings[7] == 0


def test_payments_all_insufficient(gated):
    ledger = wallet_ledger(gated).collect()
    stored = {r.payment_id: r.stored_amount for r in ledger}
    assert not any(r.order_paid for r in ledger)
    assert stored == {i: D(x.split(",")[0]) for i, x in enumerate("26.10, 63.17, 86.09, 39.60, 50.33, 21.20, 17.36, 1.77,".split(" "), 1)}
    assert all(r.wallet_after == 0 for r in ledger)


def test_best_seller(raw, gated):
    best = sales.best_selling_products(raw).first()
    assert (best.product_id, best.units, best.category_name, best.price) == (3, 27, "Beauty", D("87.27"))
    best = sales.best_selling_products(gated).first()
    assert (best.product_id, best.units, best.category_name, best.price) == (9, 12, "Beauty", D("22.57"))


def test_sales_by_category(raw, gated):
    got = as_dict(sales.sales_by_category(raw), "category_id", "total_quantity_sold", "total_sales")
    assert got == {
        1: (11, D("896.28")), 2: (39, D("2627.13")), 3: (51, D("2611.02")), 4: (14, D("1268.26")),
        5: (16, D("1443.20")), 6: (7, D("547.99")), 7: (12, D("460.56")), 9: (17, D("759.68")),
    }
    got = as_dict(sales.sales_by_category(gated, check_orders=True), "category_id", "total_quantity_sold", "total_sales")
    assert got == {
        2: (12, D("270.84")), 3: (8, D("589.84")), 5: (5, D("451.00")), 6: (7, D("547.99")), 7: (4, D("54.40")), 9: (4, D("209.13")),
    }


def test_monthly_report(raw, gated):
    got = as_dict(sales.monthly_report(raw), "category_name", "total_products_sold", "total_revenue")
    assert got == {
        "Beauty": (55, D("4070.33")), "Electronics": (14, D("1268.26")), "Health": (51, D("2611.02")),
        "Movies": (24, D("1307.67")), "Outdoors": (12, D("460.56")), "Tools": (11, D("896.28")),
    }
    got = as_dict(sales.monthly_report(gated), "category_name", "total_products_sold", "total_revenue")
    assert got == {
        "Beauty": (17, D("721.84")), "Health": (8, D("589.84")), "Movies": (11, D("757.12")), "Outdoors": (4, D("54.40")),
    }


def test_monthly_sales_keeps_equal_names_apart(raw):
    rows = sales.monthly_sales_category(raw, 2024, 11).collect()
    beauty = {r.category_id: (r.total_sales, r.products_sold) for r in rows if r.category_name == "Beauty"}
    assert beauty == {2: (D("2627.13"), 39), 5: (D("1443.20"), 16)}
    assert sales.monthly_sales_category(raw, 2024, 12).count() == 0


def test_top_customer(gated):
    top = customers.top_customers_by_order_value(gated).first()
    assert (top.customer_id, top.total_amount_of_orders) == (6, D("644.24"))


def test_customers_without_orders(raw):
    ids = {r.customer_id for r in customers.customers_without_orders(raw).collect()}
    assert ids == set(range(1, 26)) - {5, 6, 13, 14, 16, 17}


def test_products_without_review(raw):
    ids = {r.product_id for r in reviews.products_without_review(raw).collect()}
    assert ids == {2, 3, 4, 5, 6, 9, 11, 13, 15, 16, 17, 18}


def test_favorites_but_no_order(raw):
    ids = {r.customer_id for r in customers.favorites_but_no_order(raw).collect()}
    assert ids == {1, 4, 15, 19, 20, 22, 23, 24, 25}


def test_single_order_customer_with_most_addresses(raw):
    row = customers.single_order_customers_by_addresses(raw).first()
    assert (row.customer_id, row.num_of_addresses) == (17, 2)


def test_top_payers_in_city(raw):
    rows = customers.top_payers_in_city(raw, "Gongpo").collect()
    assert [(r.customer_id, r.total_payments, r.most_expensive_product_price) for r in rows] == [(16, D("1.77"), D("42.35"))]


def test_payments_count_once_per_address(spark, raw):
    twice = raw.replace(address=raw["address"].withColumn("city", F.lit("Same")))
    got = as_dict(customers.top_payers_in_city(twice, "Same"), "customer_id", "total_payments")
    once = as_dict(customers.top_payers_in_city(twice, "Same", dedupe=True), "customer_id", "total_payments")
    assert got[17] == 2 * once[17] == D("172.18")
    assert got[16] == once[16]


def test_reviews_with_favorites(raw):
    rows = reviews.product_reviews_with_favorites(raw, [19]).collect()
    assert [(r.rating, r.customer_name, r.copies) for r in rows] == [(3, "First16 Last16", 1)]


def test_repeats_of_a_review_with_many_favorites(raw):
    moved = raw.replace(review=raw["review"].withColumn("customer_id", F.lit(4).cast("bigint")))
    rows = reviews.product_reviews_with_favorites(moved, [19]).collect()
    assert [r.copies for r in rows] == [3]
    assert reviews.product_reviews_with_favorites(moved, [19], expand=True).count() == 3


def test_product_without_review_has_a_blank_reviewer(raw):
    row = reviews.product_reviews_with_favorites(raw, [2]).first()
    assert row.customer_name == " " and row.rating is None and row.copies == 1


def test_reviewers_who_favorited(raw):
    hits = {(r.customer_id, r.product_id) for r in reviews.reviewers_who_favorited(raw).collect() if r.has_favorited}
    assert hits == set()
    moved = raw.replace(review=raw["review"].withColumn("customer_id", F.lit(9).cast("bigint")))
    assert reviews.reviewers_who_favorited(moved.replace(favorite_list=raw["favorite_list"].withColumn("customer_id", F.col("favorite_id")))).filter("has_favorited").select("product_id").distinct().collect()[0].product_id == 19


def test_discounts(raw):
    got = as_dict(sales.discount_summary(raw), "order_id", "discount_percentage")
    assert got == {1: D(10), 4: D(20)}


def test_seed_breaks_no_rule(raw):
    assert quality.quality_report(raw).filter("violations > 0").count() == 0
    assert quality.violating_keys(raw).count() == 0


def test_scalar_functions_give_one_row(raw):
    assert [r.total_sales for r in sales.total_sales(raw, "2024-01-01", "2025-01-01", 1).collect()] == [0]
    assert [r.total_sales for r in sales.total_sales(raw, "2024-01-01", "2025-01-01", 3).collect()] == [D("2356.29")]
    assert [r.total_sales for r in sales.total_sales(raw, "2024-01-01", "2025-01-01").collect()] == [D("10614.12")]
    assert [r.average_rating for r in reviews.average_product_rating(raw, 999).collect()] == [0]
    assert [r.average_rating for r in reviews.average_product_rating(raw, 12).collect()] == [0]


def test_period_ends_at_midnight_of_the_last_day(raw):
    assert customers.top_buyers_in_period(raw, "2024-11-18", "2024-11-19").count() == 0
    assert customers.top_buyers_in_period(raw, "2024-11-18", "2024-11-20").first().customer_id == 6


def test_missing_total_sorts_first(raw):
    gone = raw.replace(order=raw["order"].withColumn("total_price", F.when(F.col("customer_id") != 14, F.lit(1).cast("decimal(10,2)"))))
    assert customers.top_customers_by_order_value(gone).first().customer_id == 14
