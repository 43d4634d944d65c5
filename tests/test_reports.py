import glob
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from seed import frame, seed_tables
from tradepost.operators import derive, lookups, reviews, sales
from tradepost.plans import catalog
from tradepost.functions.batches import newest, put_batch, stored
from tradepost.sources import TABLES, load

D = Decimal


@pytest.fixture(scope="module")
def shop(spark):
    return seed_tables(spark)


def test_lookups(spark, shop):
    assert lookups.customer_by_username(shop, ["user3", "nobody"]).first().customer_id == 3
    assert "customer_id" not in lookups.addresses_of_customer(shop, [17]).columns
    assert lookups.addresses_of_customer(shop, [17]).count() == 2
    keys = frame(spark, [(2,), (8,), (8,), (99,)], "order_id bigint")
    assert {r.order_id: r.status for r in lookups.order_status(shop, keys).collect()} == {2: False, 8: False}


def test_order_details_in_pages(spark, shop):
    whole = {r.order_id: [p.product_id for p in r.products] for r in lookups.order_details(shop).collect()}
    assert whole[7] == [2, 3, 11, 13]
    pages = lookups.order_details(shop, [7], page_rows=3).orderBy("page").collect()
    assert [[p.product_id for p in r.products] for r in pages] == [[2, 3, 11], [13]]


def test_order_without_items(spark, shop):
    none = shop.replace(order_items=shop["order_items"].filter("order_id <> 8"))
    assert lookups.order_details(none, [8]).first().products == []


def test_filter_products(shop):
    def ids(**filters):
        return {r.product_id for r in lookups.filter_products(shop, **filters).collect()}

    assert ids(category_name="Beauty") == {3, 9}
    assert len(ids(category_name="Nothing")) == 20
    assert ids(category_name="Nothing", unknown_category="empty") == set()
    assert ids(min_price=90.2, max_price=93.45) == {2, 5, 7}
    assert ids(category_name="Tools", max_price=60) == {19}
    assert len(ids()) == 20


def test_settlement(spark, shop):
    payments = [(1, 60, 1), (2, 40, 1), (3, 5, 1), (4, 10, 2), (5, 100, 3)]
    t = shop.replace(
        order=shop["order"].withColumn("total_price", F.lit(100).cast("decimal(10,2)")),
        payment=frame(spark, [(p, D(a), o) for p, a, o in payments], "payment_id bigint, amount decimal(10,2), order_id bigint"),
    )
    rows = {r.order_id: (r.paid, r.settled_by, r.excess, r.total_paid) for r in derive.payment_settlement(t).collect()}
    assert rows == {1: (True, 2, 0, 105), 2: (False, None, None, 10), 3: (True, 5, 0, 100)}


def test_notices(spark, shop):
    got = {r.review_id: (r.kind, r.message) for r in derive.review_notifications(shop["review"]).collect()}
    assert got[10] == ("rating", "new review added for product 7 by customer :17 rating :3 ")
    assert got[2] == ("comment", "new review added for product 10 by customer :13 comment :text 2 ")
    assert got[5] == ("both", "new review added for product 10 by customer :14 rating :4 comment :text 5 ")


def test_history_documents(spark, shop):
    t = shop.replace(
        order=shop["order"].withColumn("status", F.col("order_id").isin(8, 6)),
        order_items=shop["order_items"].filter("order_id <> 6"),
    )
    text = {r.order_id: r.order_details for r in derive.history_json(derive.order_history(t)).collect()}
    assert text[8] == '{"order_date":"2024-11-19T12:00:00.000","total_price":0.00,"status":true,"items":[{"product_id":18,"quantity":4,"price":13.60}]}'
    assert text[6].endswith('"items":null}')


def test_history_of_repeated_transitions(spark, shop):
    twice = frame(spark, [(7,), (7,), (8,)], "order_id bigint")
    rows = derive.order_history(shop, twice, last_id=5, as_of="2024-12-01").orderBy("log_id").collect()
    assert [(r.log_id, r.order_id) for r in rows] == [(6, 7), (7, 7), (8, 8)]
    assert {str(r.logged_at) for r in rows} == {"2024-12-01 00:00:00"}
    assert derive.order_history(shop, twice).columns == TABLES["order_history_log"].schema.fieldNames()
    assert derive.order_history(shop, twice, dedupe=True).count() == 2
    pages = derive.order_history(shop, twice, page_rows=2).groupBy("order_id", "page").count().collect()
    assert {(r.order_id, r.page): r["count"] for r in pages} == {(7, 0): 2, (7, 1): 2, (8, 0): 1}


def test_wrong_address_is_refused(spark, shop):
    orders = frame(spark, [(1, 17, 1), (2, 17, 3), (3, 17, 999), (4, None, 1)], "order_id bigint, customer_id bigint, address_id bigint")
    checked = {r.order_id: r.accepted for r in derive.check_order_addresses(orders, shop["address"]).collect()}
    assert checked == {1: True, 2: False, 3: False, 4: False}


def test_revenue_adds_up(shop):
    by_category = sales.sales_by_category(shop).agg(F.sum("total_sales")).first()[0]
    by_order = derive.order_totals(shop).agg(F.sum("total_price")).first()[0]
    assert by_category == by_order


def test_views_by_name(spark, shop):
    catalog.register_views(shop)
    assert spark.sql("select sum(total_quantity_sold) from popular_products").first()[0] == 167
    assert spark.sql("select city from payment_details where total_amount = 1.77").first()[0] == "Gongpo"
    assert spark.table("users_favorites").count() == 13
    assert spark.table("user_orders").count() == 8
    assert spark.sql("select total_spent from total_spending_per_user where customer_id = 16").first()[0] == D("1.77")


def test_products_read_in_both_ways_agree(shop, limits):
    def everything():
        return {
            name: sorted(map(str, summary.build(shop).collect())) for name, summary in catalog.SUMMARIES.items()
        }

    small = everything()
    limits.broadcast_bytes = 0
    assert everything() == small


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def by_months(shop):
    return shop.replace(order=shop["order"].withColumn("order_date", F.expr("order_date + make_ym_interval(0, cast(order_id as int))")))


def told(df):
    return sorted(map(str, df.collect()))


def test_only_touched_months_are_written(spark, shop, folder):
    t = by_months(shop)
    old = t.replace(order_items=t["order_items"].filter("order_id <> 4"))
    catalog.write_summaries(old, folder, ["monthly_report"])
    before = files(f"{folder}/monthly_report")
    added = t["order_items"].filter("order_id = 4")
    got = catalog.refresh_summary("monthly_report", 1, {"order_items": added, "order": t["order"]}, t, folder)
    assert told(got) == told(sales.monthly_report(t))
    after = files(f"{folder}/monthly_report")
    kept = {f for f in before if "part=2025-03" not in f}
    assert len(kept) >= 5 and all(after.get(f) == before[f] for f in kept) and any("part=2025-03" in f for f in after)


def test_a_month_without_items_goes(spark, shop, folder):
    t = by_months(shop)
    catalog.write_summaries(t, folder, ["monthly_report"])
    gone = t["order_items"].filter("order_id = 5").withColumn("sign", F.lit(-1))
    left = t.replace(order_items=t["order_items"].filter("order_id <> 5"))
    for _ in range(2):  # a repeated batch changes nothing
        got = catalog.refresh_summary("monthly_report", 1, {"order_items": gone, "order": t["order"]}, left, folder)
        assert told(got) == told(sales.monthly_report(left)) and got.count() < sales.monthly_report(t).count()


@pytest.mark.parametrize("name", ["monthly_report", "sales_by_category", "product_summary"])
def test_a_moved_product(spark, shop, folder, name):
    t = by_months(shop)
    catalog.write_summaries(t, folder, [name])
    change = F.col("product_id") == 3
    moved = t.replace(product=t["product"].withColumns({"category_id": F.when(change, 10).otherwise(F.col("category_id")).cast("bigint"), "name": F.when(change, "New").otherwise(F.col("name"))}))
    none = {"order_items": t["order_items"].limit(0), "order": t["order"]}
    got = catalog.refresh_summary(name, 1, none, moved, folder, spark.createDataFrame([(3,)], "product_id bigint"))
    assert told(got) == told(catalog.SUMMARIES[name].build(moved).select(got.columns)) != told(catalog.SUMMARIES[name].build(t).select(got.columns))


def test_deleted_and_rated_anew_reviews_and_a_new_customer(spark, shop, folder):
    catalog.write_summaries(shop, folder, ["reviews"])
    review = shop["review"]
    gone, changed = review.filter("review_id = 5"), review.filter("review_id = 6")
    changes = gone.withColumn("sign", F.lit(-1)).unionByName(changed.withColumn("sign", F.lit(-1)))
    changes = changes.unionByName(changed.withColumn("rating", F.lit(1)).withColumn("sign", F.lit(1)))
    person = shop["customer"].limit(1).withColumn("customer_id", F.lit(777).cast("bigint"))
    now = shop.replace(
        review=review.filter("review_id <> 5").withColumn("rating", F.when(F.col("review_id") == 6, 1).otherwise(F.col("rating"))),
        customer=shop["customer"].unionByName(person),
    )
    got = catalog.refresh_summary("reviews", 1, {"review": changes}, now, folder, person.select("customer_id"))
    assert told(got) == told(reviews.customer_reviews(now))


def test_empty_tables_give_empty_summaries(spark, shop, folder):
    none = shop.replace(**{n: shop[n].limit(0) for n in ("order_items", "review", "product", "customer", "discount_code")})
    catalog.write_summaries(none, folder)
    for name in catalog.SUMMARIES:
        got = catalog.read_summary(none, name, folder)
        assert got.isEmpty() and got.columns == catalog.SUMMARIES[name].build(none).columns


@pytest.mark.parametrize("name", list(catalog.SUMMARIES))
def test_refresh_in_batches_equals_one_build(spark, shop, folder, name):
    odd = F.col("order_id") % 2 == 1
    parts = [
        shop.replace(order_items=shop["order_items"].filter(c), review=shop["review"].filter(r))
        for c, r in ((odd, F.col("review_id") < 4), (~odd, F.col("review_id") >= 4))
    ]
    for batch, new in [(0, parts[0]), (1, parts[1]), (1, parts[1])]:
        result = catalog.refresh_summary(name, batch, new, shop, folder)
    expected = catalog.SUMMARIES[name].build(shop)
    assert sorted(map(str, result.select(*expected.columns).collect())) == sorted(map(str, expected.collect()))


def test_batches(spark, folder):
    columns = "k bigint, v bigint"
    assert stored(spark, f"{folder}/t", columns).count() == 0
    for batch, some in [(0, [(1, 10), (2, 20)]), (1, [(1, 11)]), (2, [(2, 99)]), (2, [(2, 22)])]:
        put_batch(frame(spark, some, columns), f"{folder}/t", batch)
    kept = stored(spark, f"{folder}/t", columns)
    assert {r.k: r.v for r in newest(kept, "k").collect()} == {1: 11, 2: 22}
    assert {r.k: r.v for r in newest(kept.filter("batch < 2"), "k").collect()} == {1: 11, 2: 20}


def test_load_reads_the_declared_schema(spark, shop, folder):
    for name in shop:
        shop[name].withColumn("password", F.lit("secret")).write.parquet(f"{folder}/{name}")
    read = load(spark, folder)
    assert read["customer"].columns == TABLES["customer"].schema.fieldNames()
    assert sales.monthly_report(read).count() == 6
