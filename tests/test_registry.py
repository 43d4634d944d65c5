"""A sample of the registered queries against their SQL; ``compare.py`` does all of them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from checks.registry import QUERIES
from checks.sql import SQL
from compare import TABLES, compare
from seed import seed_tables
from tradepost.operators import derive
from tradepost.sources.layout import load_bucketed, save_bucketed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql())


BATCHES = [
    "add_to_favorites", "add_to_favorites_log", "create_orders", "create_orders_log", "apply_discounts", "payment_progress", "wallet_ledger",
    "allocate_stock_status", "register_customers", "order_history", "add_phone_numbers",
]


@pytest.mark.parametrize("name", BATCHES)
def test_no_limit_changes_an_answer(spark, con, limits, name):
    for field in vars(limits):
        setattr(limits, field, 5)
    limits.broadcast_keys = 0
    ok, text = compare(spark, con, SF, name)
    assert ok, text


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize(
    "name",
    [
        "load_tables", "ingest_rejects", "monthly_report", "top_payers_by_city", "product_reviews_with_favorites", "order_details",
        "add_phone_numbers", "update_customers", "apply_discounts", "payment_settlement", "wallet_ledger_shared", "allocate_stock",
        "order_history", "dq_checks", "dq_foreign_keys", "stream_daily_sales", "stream_daily_sales_late", "stream_stock_gate_status",
    ],
)
def test_against_sql(spark, con, name):
    ok, text = compare(spark, con, SF, name)
    assert ok, text


def test_bucketed_tables_join_without_a_shuffle(spark, folder):
    shop = seed_tables(spark)
    save_bucketed(shop, folder, "bucket_test_", 4)
    stored = load_bucketed(spark, "bucket_test_")
    assert set(stored) == set(shop)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = stored["payment"].join(stored["order"].select("order_id", "total_price"), "order_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        got = derive.payment_settlement(stored).agg(F.sum("total_paid")).first()[0]
        assert got == derive.payment_settlement(shop).agg(F.sum("total_paid")).first()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in stored:
            spark.sql(f"drop table `bucket_test_{name}`")
