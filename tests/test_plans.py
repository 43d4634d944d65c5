"""What the physical plans must and must not contain."""

import re

import pytest

from checks.registry import QUERIES
from seed import frame, seed_tables
from tradepost.functions.joins import reduced
from tradepost.functions.scan import numbered
from tradepost.operators import cascade, customers, derive, lookups, reviews, sales
from tradepost.sources import shop_tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


REPORTS = [
    "monthly_report", "best_selling_product", "customers_without_orders", "favorites_but_no_order", "products_without_review",
    "top_payers_by_city", "order_item_history", "payment_details", "users_favorites", "reviews", "product_summary",
    "filter_products", "order_details", "payment_settlement", "dq_foreign_keys",
]


@pytest.mark.parametrize("name", REPORTS)
def test_no_nested_loops_or_products(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_missing_orders_need_no_null_aware_join(spark):
    text = plan(customers.customers_without_orders(shop_tables(spark, SF)))
    assert "LeftAnti" in text and "isNullAwareAntiJoin=true" not in text


def test_month_is_pushed_to_the_scan(spark):
    text = plan(sales.monthly_sales_category(shop_tables(spark, SF), 1996, 12))
    assert "GreaterThanOrEqual(o_orderdate,1996-12-01T00:00), LessThan(o_orderdate,1" in text


def test_scans_read_only_needed_columns(spark):
    text = plan(sales.popular_products(shop_tables(spark, SF)))
    assert "l_shipdate" not in text and "p_retailprice" not in text and "l_extendedprice" not in text


def test_top_n_is_not_a_full_sort(spark):
    text = plan(sales.best_selling_products(shop_tables(spark, SF), 5))
    assert "TakeOrderedAndProject" in text


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_sides_are_not_broadcast(spark, no_broadcast):
    t = seed_tables(spark)
    text = plan(sales.sales_by_category(t)) + plan(reviews.users_favorites(t)) + plan(customers.payment_details(t))
    assert "BroadcastExchange" not in text and "SortMergeJoin" in text


@pytest.mark.parametrize(
    "build, scans", [(lambda t: sales.order_item_history(t, "1998-01-01"), 6), (customers.payment_details, 5), (reviews.users_favorites, 5)]
)
def test_reports_read_each_table_once_and_start_no_job(spark, no_broadcast, build, scans):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans", "plans")
    before = len(tracker.getJobIdsForGroup("plans"))
    text = plan(build(seed_tables(spark)))
    assert len(re.findall(r"(?m)^\W*(?:\* ?\(?\d*\)? ?)?(?:Scan|FileScan|LocalTableScan|BatchScan)", text)) <= scans
    assert len(tracker.getJobIdsForGroup("plans")) == before


def test_history_and_details_shuffle_little(spark, no_broadcast):
    t = seed_tables(spark)
    assert plan(lookups.order_details(t)).count("Exchange hashpartitioning") <= 6
    assert plan(derive.order_history(t, as_of="2002-01-01")).count("Exchange hashpartitioning") <= 6


def test_sparse_numbers_are_not_numbered_in_one_task(spark, limits):
    limits.window_rows = 10
    df = frame(spark, [(i * 300_000,) for i in range(1000)], "seq bigint").repartition(4)
    numbers = numbered(df, "seq")
    assert [r.position for r in numbers.orderBy("seq").collect()] == list(range(1, 1001))
    text = plan(numbers)
    single = text[text.index("SinglePartition") :]
    assert "HashAggregate" in single.splitlines()[1]  # what is brought together are sums per partition


def test_cascade_reads_little(spark, no_broadcast):
    t = shop_tables(spark, SF)
    names = frame(spark, [("Customer#000000001",)], "username string")
    left = cascade.delete_customers(t, names)
    assert sum(plan(df).count("FileScan parquet") for df in left.values()) < 60


def test_a_batch_does_not_shuffle_the_whole_side(spark, no_broadcast):
    side = shop_tables(spark, SF)["product"]
    few = reduced(side, frame(spark, [(1,), (2,)], "product_id bigint"), "product_id")
    text = plan(few)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text.split("BroadcastExchange")[0]
