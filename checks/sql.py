"""The registered queries as plain SQL over the given tables."""

from __future__ import annotations

import re

# Table or request name -> its definition. Names used inside a definition are added by `query`.
DEFINITIONS = {
    "shop_customer": """
        select c_custkey as customer_id, split_part(c_name, '#', 1) as first_name, split_part(c_name, '#', 2) as last_name,
               c_name as username, cast(greatest(c_acctbal, 0) as decimal(10,2)) as wallet_balance,
               [printf('%d-%03d', c_nationkey, c_custkey % 1000)] as phone_numbers
        from customer""",
    "shop_address": """
        select c_custkey * 4 + i as address_id, c_mktsegment as street_name, cast(i as varchar) as street_number,
               r_name as country, n_name as city, cast(c_custkey as varchar) as postal_code, r_name as province,
               c_custkey as customer_id
        from customer cross join (values (0), (1), (2)) v(i)
        join nation on n_nationkey = (c_nationkey + i) % 25
        join region on r_regionkey = n_regionkey
        where i <= c_custkey % 3""",
    "shop_kind": """
        select name, half, dense_rank() over (order by name, half) as category_id
        from (select distinct p_type as name, p_partkey % 2 as half from part)""",
    "shop_category": "select category_id, name from shop_kind",
    "shop_product": """
        select p_partkey as product_id, p_name as name, cast(p_retailprice as decimal(10,2)) as price,
               p_size * 10 as stock_count, category_id, cast(0 as decimal(5,2)) as rating
        from part join shop_kind k on k.name = p_type and k.half = p_partkey % 2""",
    "shop_order": """
        select o_orderkey as order_id, o_orderdate as order_date, cast(o_totalprice as decimal(10,2)) as total_price,
               o_orderstatus = 'F' as status, o_custkey as customer_id, o_custkey * 4 as address_id
        from orders""",
    "shop_items": """
        select l_orderkey as order_id, l_partkey as product_id, cast(sum(l_quantity) as int) as quantity
        from lineitem group by all""",
    "shop_review": """
        select event_id as review_id, case when event_id % 4 <> 0 then 1 + event_id % 5 end as rating,
               case when event_id % 4 = 0 then props end as comment, user_id as customer_id,
               cast(props->>'$.k' as bigint) as product_id
        from events where event_type = 'view'""",
    "shop_list": """
        select user_id as favorite_id, cast(0 as decimal(10,2)) as total_price, min(ts) as create_date, user_id as customer_id
        from events where event_type = 'click' group by user_id""",
    "shop_list_items": """
        select user_id as favorite_id, cast(props->>'$.k' as bigint) as product_id, cast(count(*) as int) as quantity
        from events where event_type = 'click' group by all""",
    "shop_payment": """
        select order_id * 3 + i as payment_id,
               cast(total_price * case order_id % 4 when 0 then 0.25 when 1 then 0.50 when 2 then 1.00 else 0.40 end
                    as decimal(10,2)) as amount,
               'card' as method, order_date + to_days(cast(i as integer)) as payment_date, order_id, customer_id
        from shop_order cross join (values (0), (1), (2)) v(i) where i <= order_id % 3""",
    "shop_discount": """
        select order_id as discount_id, 'D' || order_id as code, cast(5 * (1 + order_id % 4) as decimal(5,2)) as percentage,
               order_id % 20 = 0 as status, order_id
        from shop_order where order_id % 10 = 0""",
    "shop_gift": """
        select order_id as gift_id, cast(10 + order_id % 90 as decimal(10,2)) as value, 'G' || order_id as code,
               order_id % 2 = 0 as status, order_id
        from shop_order where order_id % 15 = 0""",
    "ask_products": """
        select s_suppkey as seq, s_name as name, case when s_nationkey <> 0 then cast(s_acctbal as decimal(10,2)) end as price,
               s_nationkey - 2 as stock_count, 1 + s_suppkey % 14 as category_id
        from supplier""",
    "ask_favorites": """
        select event_id as seq, user_id * 2 as customer_id, cast(props->>'$.k' as bigint) * 21 as product_id,
               cast(1 + event_id % 5 as int) as quantity
        from events where event_type = 'purchase'""",
    "ask_registrations": """
        select event_id as seq, case when event_id % 7 <> 0 then 'First' || event_id end as first_name,
               'Last' || user_id as last_name,
               case when user_id % 3 = 0 then printf('Customer#%09d', user_id) else 'user' || user_id end as username
        from events where event_type = 'signup'""",
    "ask_phones": """
        select event_id as seq, user_id * 11 as customer_id, 'k' || cast(props->>'$.k' as bigint) as phone
        from events where event_type = 'error'""",
    "ask_changes": """
        select event_id as seq, printf('Customer#%09d', user_id * 11) as username,
               case when k % 3 = 0 then 'F' || event_id end as first_name,
               case when k % 3 = 1 then 'L' || event_id end as last_name,
               case when k % 5 = 0 then ['P' || event_id] end as phone_numbers
        from (select *, cast(props->>'$.k' as bigint) as k from events where event_type = 'click')""",
    "ask_order_lines": """
        select l_orderkey as seq, l_linenumber, l_suppkey, cast(l_quantity as int) as quantity,
               l_partkey + case when l_linenumber = 7 then 1000000000 else 0 end as product_id
        from lineitem""",
    "ask_orders": """
        select o_orderkey as seq, o_custkey as customer_id, o_custkey * 4 + o_orderkey % 4 as address_id,
               case when o_orderstatus = 'P' or n_lines is null then 'INCORRECT_INPUT'
                    when o_orderkey % 4 > o_custkey % 3 then 'ADDRESS_NOT_OF_CUSTOMER'
                    when n_products < n_lines then 'PRODUCT_TWICE'
                    when n_unknown > 0 then 'UNKNOWN_PRODUCT' end as refused
        from orders left join (select seq, count(*) as n_lines, count(distinct product_id) as n_products,
                                 count(*) filter (where product_id >= 1000000000) as n_unknown
                          from ask_order_lines group by seq) on seq = o_orderkey""",
    "ask_placed": """
        select *, (select max(o_orderkey) from orders) + row_number() over (order by seq) as order_id
        from ask_orders where refused is null""",
    "all_discounts": """
        select * from shop_discount
        union all
        select o_orderkey + 1000000000, 'E' || o_orderkey, cast(1 + o_orderkey % 30 as decimal(5,2)), true, o_orderkey
        from orders where o_orderpriority = '1-URGENT'""",
    "all_gifts": """
        select * from shop_gift
        union all
        select o_orderkey + 1000000000, cast(1000 * (o_orderkey % 90) as decimal(10,2)), 'H' || o_orderkey, true, o_orderkey
        from orders where o_orderpriority = '1-URGENT'""",
    "new_people": """
        select event_id + 1000000000 as customer_id, event_id as e, 'New' || event_id as first_name, 'Customer' as last_name,
               'new' || event_id as username
        from events where event_type = 'signup'""",
    "ask_stock": """
        select order_id as seq, case when order_id % 9 = 0 then null when order_id % 7 = 0 then product_id + 1000000000
                    else product_id end as product_id, case when order_id % 5 <> 0 then quantity end as quantity
        from shop_items""",
    "array_orders": """
        select o_orderkey as seq, o_custkey as customer_id, o_custkey * 4 + o_orderkey % 4 as address_id,
               case when o_orderkey % 17 = 0 or o_orderkey % 13 = 0 or o_orderkey % 11 = 0 then 'INCORRECT_INPUT'
                    when o_orderkey % 4 > o_custkey % 3 then 'ADDRESS_NOT_OF_CUSTOMER'
                    when n_products < n_lines then 'PRODUCT_TWICE' end as refused
        from orders join (select seq, count(*) as n_lines, count(distinct product_id) as n_products
                          from ask_order_lines where product_id < 1000000000 group by seq) on seq = o_orderkey""",
    "array_placed": """
        select *, (select max(o_orderkey) from orders) + row_number() over (order by seq) as order_id
        from array_orders where refused is null""",
    "leaving": "select c_custkey as customer_id from customer where c_mktsegment = 'BUILDING'",
}

# Greedy walk over numbered requests (product_id, seq, quantity, stock, n) of table {source}.
GREEDY = """
    {source}_numbered as (
        select *, row_number() over (partition by product_id order by seq) as n from {source}),
    {source}_walk as (
        select product_id, seq, quantity, n, quantity <= stock as accepted,
               case when quantity <= stock then stock - quantity else stock end as remaining
        from {source}_numbered where n = 1
        union all
        select r.product_id, r.seq, r.quantity, r.n, r.quantity <= w.remaining,
               case when r.quantity <= w.remaining then w.remaining - r.quantity else w.remaining end
        from {source}_walk w join {source}_numbered r on r.product_id = w.product_id and r.n = w.n + 1)"""


def query(body: str, extra: str = "") -> str:
    """``body`` with the definitions it names, and the common tables ``extra`` after them."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name, definition in DEFINITIONS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                add(definition)
                needed.append(name)

    add(extra)
    add(body)
    tables = [f"{name} as ({DEFINITIONS[name]})" for name in needed]
    if extra:
        tables.append(extra)
    return (f"with recursive {', '.join(tables)} " if tables else "") + body


MEAN2 = "cast(floor((200 * sum(rating) + count(rating)) / (2 * count(rating))) / 100 as decimal(10,2))"
NAME = "coalesce(c.first_name, '') || ' ' || coalesce(c.last_name, '')"
MONEY = "decimal(18,2)"
IDLE = """select distinct customer_id from shop_order
          where order_date between timestamp '1996-01-01' and timestamp '1996-06-30'"""

SQL: dict[str, str] = {}


def add(name: str, body: str, extra: str = "") -> None:
    SQL[name] = query(body, extra)


# ---- tables -------------------------------------------------------------------------------------
_counted = {
    "customer": ("shop_customer", "customer_id"),
    "address": ("shop_address", "address_id"),
    "category": ("shop_category", "category_id"),
    "product": ("shop_product", "product_id"),
    "review": ("shop_review", "review_id"),
    "favorite_list": ("shop_list", "favorite_id"),
    "favorite_list_items": ("shop_list_items", "favorite_id"),
    "order": ("shop_order", "order_id"),
    "payment": ("shop_payment", "payment_id"),
    "order_items": ("shop_items", "order_id"),
    "discount_code": ("shop_discount", "discount_id"),
    "gift_card": ("shop_gift", "gift_id"),
}
add(
    "load_tables",
    " union all ".join(
        f"select '{name}' as table_name, cast(count(*) as bigint) as n_rows, cast(sum({key}) as bigint) as key_sum from {source}"
        for name, (source, key) in _counted.items()
    )
    + " union all select 'order_history_log', 0, null",
)
_ingest = """
    typed as (
        select event_id as seq, case when event_id % 11 = 0 then 'good' when event_id % 5 <> 0
                    then cast(cast((event_id % 130) / 20 as decimal(6,2)) as varchar) end as given,
               case when event_id % 3 = 0 then props end as comment, user_id as customer_id,
               cast(props->>'$.k' as bigint) * 21 as product_id
        from events where event_type = 'purchase'),
    rated as (select *, cast(round(try_cast(given as decimal(38,10))) as int) as rating from typed),
    faulty as (
        select r.*, concat_ws(',', case when given = 'good' then 'type:rating' end,
               case when rating < 1 or rating > 5 then 'check:rating_1_to_5' end,
               case when comment is null and rating is null then 'check:comment_or_rating' end,
               case when p_partkey is null then 'foreign_key:product_id' end) as reasons
        from rated r left join part on p_partkey = product_id)"""
add(
    "ingest_rows",
    """select cast((select max(event_id) from events where event_type = 'view') + row_number() over (order by seq) as bigint)
              as review_id, rating, comment, customer_id, product_id
       from faulty where reasons = ''""",
    _ingest,
)
add("ingest_rejects", "select seq, reasons from faulty where reasons <> ''", _ingest)

# ---- analytic queries ---------------------------------------------------------------------------
add(
    "top_buyers_in_period",
    """select customer_id, count(*) as number_of_orders from shop_order
       where order_date between timestamp '1996-01-01' and timestamp '1997-01-01'
       group by customer_id order by number_of_orders desc, customer_id limit 10""",
)
add(
    "best_selling_product",
    """select p.product_id, p.name as product_name, p.price, c.name as category_name, cast(sum(i.quantity) as bigint) as units
       from shop_product p join shop_category c using (category_id) join shop_items i using (product_id)
       group by all order by units desc, p.product_id limit 10""",
)
add(
    "product_reviews_with_favorites",
    f"""select p.product_id, p.name as product_name, r.review_id, r.rating, r.comment,
              {NAME} as customer_name, count(*) as copies
       from shop_product p left join shop_review r using (product_id)
       left join shop_customer c on c.customer_id = r.customer_id
       left join shop_list f on f.customer_id = c.customer_id
       left join shop_list_items i on i.favorite_id = f.favorite_id
       group by all""",
)
add(
    "reviewers_who_favorited",
    f"""select r.review_id, r.product_id, p.name as product_name, r.rating, r.comment, r.customer_id,
              {NAME} as customer_name,
              exists (select 1 from shop_list f join shop_list_items i using (favorite_id)
                      where f.customer_id = r.customer_id and i.product_id = r.product_id) as has_favorited
       from shop_review r join shop_product p using (product_id) join shop_customer c on c.customer_id = r.customer_id""",
)
add(
    "order_item_history",
    f"""select o.customer_id, {NAME} as customer_name, o.order_id, i.product_id, p.name as product_name, p.price,
              k.name as category_name
       from shop_customer c join shop_order o using (customer_id) join shop_items i using (order_id)
       join shop_product p using (product_id) join shop_category k using (category_id)
       where o.order_date < timestamp '1998-01-01'""",
)
add(
    "customers_without_orders",
    f"""select customer_id, first_name, last_name, username, wallet_balance from shop_customer
       where customer_id not in ({IDLE})""",
)
_payers = f"""
    select a.city, c.customer_id, {NAME} as customer_name, cast(sum(p.amount) as {MONEY}) as total_payments,
           max(d.dearest) as most_expensive_product_price, max(o.order_date) as last_order_date
    from shop_customer c join shop_address a using (customer_id) join shop_order o on o.customer_id = c.customer_id
    join shop_payment p on p.order_id = o.order_id
    left join (select i.order_id, max(price) as dearest from shop_items i join shop_product using (product_id)
               group by i.order_id) d on d.order_id = o.order_id
    {{where}} group by all"""
add("top_payers_by_city", _payers.format(where=""))
add(
    "top_payers_in_city",
    "select * exclude (city) from (" + _payers.format(where="where a.city = 'NATION_7'") + ")",
)
add(
    "avg_rating_per_product",
    """select p.product_id, p.name, c.name as category_name,
              cast(cast(sum(r.rating) as decimal(18,6)) / count(r.rating) as decimal(18,6)) as average_rating
       from shop_product p join shop_category c using (category_id) left join shop_review r using (product_id)
       group by all""",
)
add(
    "products_without_review",
    """select p.product_id, p.name, p.price from shop_product p left join shop_review r using (product_id)
       where r.review_id is null""",
)
add(
    "favorites_but_no_order",
    f"""select distinct c.customer_id, {NAME} as customer_name from shop_customer c join shop_list f using (customer_id)
       where c.customer_id not in ({IDLE})""",
)
add(
    "top_customer_by_order_value",
    f"""select c.customer_id, {NAME} as customer_name, cast(sum(o.total_price) as {MONEY}) as total_amount_of_orders
       from shop_customer c join shop_order o using (customer_id)
       group by all order by total_amount_of_orders desc, c.customer_id limit 10""",
)
add(
    "single_order_customers_by_addresses",
    f"""select a.customer_id, {NAME} as customer_name, count(*) as num_of_addresses
       from shop_address a join shop_customer c using (customer_id)
       where a.customer_id in (select customer_id from shop_order where order_date <= timestamp '1996-01-01'
                               group by customer_id having count(*) = 1)
       group by all order by num_of_addresses desc, a.customer_id limit 25""",
)

add(
    "customers_without_orders_all",
    """select customer_id, first_name, last_name, username, wallet_balance from shop_customer
       where customer_id not in (select customer_id from shop_order)
       union all
       select customer_id, first_name, last_name, username, null from new_people where e % 3 <> 0""",
)
add(
    "favorites_but_no_order_all",
    f"""select distinct c.customer_id, {NAME} as customer_name from shop_customer c join shop_list f using (customer_id)
       where c.customer_id not in (select customer_id from shop_order)
       union all
       select c.customer_id, {NAME} from new_people c where e % 2 = 0 and e % 3 <> 0""",
)
add(
    "single_order_customers_by_addresses_all",
    f"""select customer_id, {NAME} as customer_name, num_of_addresses from (
         select customer_id, first_name, last_name, count(*) as num_of_addresses
         from shop_customer join shop_address using (customer_id)
         where customer_id in (select customer_id from shop_order group by customer_id having count(*) = 1) group by all
         union all
         select customer_id, first_name, last_name, 1 + e % 4 from new_people where e % 3 = 0) c
       order by num_of_addresses desc, customer_id limit 25""",
)

# ---- functions ----------------------------------------------------------------------------------
add(
    "total_sales_of_product",
    f"""select cast(coalesce(sum(i.quantity * p.price), 0) as {MONEY}) as total_sales
       from shop_items i join shop_order o using (order_id) join shop_product p using (product_id)
       where o.order_date between timestamp '1996-01-01' and timestamp '1997-01-01' and i.product_id = 7""",
)
add(
    "total_sales",
    f"""select cast(coalesce(sum(i.quantity * p.price), 0) as {MONEY}) as total_sales
       from shop_items i join shop_order o using (order_id) join shop_product p using (product_id)
       where o.order_date between timestamp '1996-01-01' and timestamp '1997-01-01'""",
)
add(
    "total_sales_by_product",
    f"""select p.product_id, cast(coalesce(sum(s.quantity * p.price), 0) as {MONEY}) as total_sales
       from shop_product p left join (
           select i.product_id, i.quantity from shop_items i join shop_order o using (order_id)
           where o.order_date between timestamp '1996-01-01' and timestamp '1996-02-01') s using (product_id)
       group by p.product_id""",
)
add(
    "monthly_sales_category",
    f"""select c.category_id, c.name as category_name, cast(sum(i.quantity * p.price) as {MONEY}) as total_sales,
              cast(sum(i.quantity) as bigint) as products_sold
       from shop_order o join shop_items i using (order_id) join shop_product p using (product_id)
       join shop_category c using (category_id)
       where extract(year from o.order_date) = 1996 and extract(month from o.order_date) = 12
       group by c.category_id, c.name""",
)
add(
    "average_product_rating",
    f"""select product_id, coalesce({MEAN2}, 0) as average_rating
       from (select product_id from shop_product) left join shop_review using (product_id)
       group by product_id""",
)

# ---- views and stored summaries -----------------------------------------------------------------
add(
    "payment_details",
    """select p.payment_id, p.payment_date, p.amount as total_amount, a.city, a.country
       from shop_payment p join shop_order o using (order_id) join shop_address a on a.address_id = o.address_id""",
)
add(
    "users_favorites",
    f"""select c.customer_id, {NAME} as full_name, p.product_id, p.name as product_name, p.price
       from shop_customer c join shop_list f using (customer_id) join shop_list_items i using (favorite_id)
       join shop_product p using (product_id)""",
)
add("user_orders", "select c.customer_id, o.order_id, o.total_price from shop_order o join shop_customer c using (customer_id)")
add(
    "popular_products",
    """select p.product_id, p.name as product_name, cast(sum(i.quantity) as bigint) as total_quantity_sold
       from shop_items i join shop_product p using (product_id) group by all""",
)
add(
    "total_spending_per_user",
    f"""select c.customer_id, c.first_name, c.last_name, cast(sum(p.amount) as {MONEY}) as total_spent
       from shop_customer c join shop_payment p using (customer_id) group by all""",
)
add(
    "view_catalog",
    " union all ".join(
        f"select '{name}' as view_name, cast(count(*) as bigint) as n_rows from ({SQL[name]})"
        for name in ("payment_details", "popular_products", "total_spending_per_user", "user_orders", "users_favorites")
    ),
)
add(
    "reviews",
    """select c.customer_id, c.first_name, c.last_name, count(r.review_id) as total_reviews,
              coalesce(cast(cast(sum(rating) as decimal(18,6)) / count(rating) as decimal(18,6)), 0) as average_rating
       from shop_customer c left join shop_review r using (customer_id) group by all""",
)
add(
    "product_summary",
    """select p.product_id, p.name as product_name, p.price, p.stock_count,
              cast(coalesce(sum(i.quantity), 0) as bigint) as times_purchased
       from shop_product p left join shop_items i using (product_id) group by all""",
)
add(
    "discount_summary",
    """select o.order_id, d.code as discount_code, d.percentage as discount_percentage, o.total_price
       from shop_order o left join shop_discount d using (order_id) where d.status""",
)
add(
    "sales_by_category",
    f"""select c.category_id, c.name, cast(sum(i.quantity) as bigint) as total_quantity_sold,
              cast(sum(i.quantity * p.price) as {MONEY}) as total_sales
       from shop_category c join shop_product p using (category_id) join shop_items i using (product_id)
       join shop_order o using (order_id) group by c.category_id, c.name""",
)
add(
    "monthly_report",
    f"""select c.name as category_name, date_trunc('month', o.order_date) as sales_month,
              cast(sum(i.quantity) as bigint) as total_products_sold,
              cast(sum(i.quantity * p.price) as {MONEY}) as total_revenue
       from shop_order o join shop_items i using (order_id) join shop_product p using (product_id)
       join shop_category c using (category_id) group by all""",
)
SQL["mv_snapshot"] = SQL["monthly_report"]
for _name in ("reviews", "product_summary", "discount_summary", "sales_by_category", "monthly_report"):
    SQL[f"mv_snapshot_{_name}"] = SQL[_name]
    SQL[f"mv_refresh_{_name}"] = SQL[_name]
SQL["mv_refresh"] = SQL["monthly_report"]

# ---- lookups ------------------------------------------------------------------------------------
add(
    "customer_by_username",
    """select customer_id, first_name, last_name, username, wallet_balance from shop_customer
       where username in (select username from ask_changes)""",
)
add(
    "addresses_of_customer",
    """select address_id, street_name, street_number, country, city, postal_code, province from shop_address
       where customer_id in (select user_id from events)""",
)
add(
    "order_details",
    """select o.order_id, cast(o.total_price as double) as total_price, o.status, p.product_id, p.name,
              cast(p.price as double) as price, p.stock_count, cast(p.rating as double) as rating
       from shop_order o left join (shop_items i join shop_product p using (product_id)) on i.order_id = o.order_id""",
)
add(
    "filter_products",
    """select product_id, name, cast(price as double) as price, stock_count, cast(rating as double) as rating from shop_product
       where category_id = (select min(category_id) from shop_category where name = 'STANDARD')
         and price >= 905 and price <= 960""",
)
add("order_status", "select order_id, status from shop_order")

# ---- batches of requests ------------------------------------------------------------------------
_products = """
    judged as (
        select *, concat_ws(',', case when price is null then 'not_null:price' end,
               case when stock_count <= -1 then 'check:stock_not_negative' end,
               case when category_id not in (select category_id from shop_category) then 'foreign_key:category_id' end) as faults
        from ask_products),
    numbered as (
        select *, (select max(p_partkey) from part) + row_number() over (order by seq) as product_id
        from judged where faults = '')"""
add(
    "add_products",
    """select product_id, name, price, stock_count, category_id, rating from shop_product
       union all
       select product_id, name, price, stock_count, category_id, 0 from numbered""",
    _products,
)
add(
    "add_products_log",
    """select seq, 'DONE' as status, product_id from numbered
       union all select seq, faults, null from judged where faults <> ''""",
    _products,
)
_favorites = """
    wanted as (
        select f.*, p.stock_count as stock from ask_favorites f join shop_product p using (product_id)
        join shop_customer c using (customer_id)),""" + GREEDY.format(source="wanted") + """,
    taken as (select w.*, customer_id from wanted_walk w join ask_favorites using (seq) where accepted),
    made as (
        select (select max(favorite_id) from shop_list) + row_number() over (order by min(seq)) as favorite_id, customer_id
        from taken where customer_id not in (select customer_id from shop_list) group by customer_id),
    lists as (
        select favorite_id, customer_id, create_date from shop_list
        union all select favorite_id, customer_id, timestamp '2002-01-01' from made),
    items as (
        select favorite_id, product_id, cast(sum(quantity) as int) as quantity
        from (select * from shop_list_items union all
              select favorite_id, t.product_id, t.quantity from taken t join lists using (customer_id))
        group by all)"""
add("add_to_favorites", "select favorite_id, product_id, quantity from items", _favorites)
add(
    "add_to_favorites_lists",
    f"""select l.favorite_id, l.customer_id, l.create_date,
              cast(coalesce(sum(case when l.customer_id in (select customer_id from taken) then i.quantity * p.price end), 0)
                   as {MONEY}) as total_price
       from lists l left join items i using (favorite_id) left join shop_product p on p.product_id = i.product_id
       group by all""",
    _favorites,
)
add(
    "add_to_favorites_stock",
    """select p.product_id, cast(p.stock_count - coalesce(sum(t.quantity), 0) as int) as stock_count
       from shop_product p left join taken t on t.product_id = p.product_id group by p.product_id, p.stock_count""",
    _favorites,
)
add(
    "add_to_favorites_log",
    """select f.seq, case when c.customer_id is null then 'UNKNOWN_CUSTOMER' when p.product_id is null then 'UNKNOWN_PRODUCT'
                        when w.accepted then 'DONE' else 'EXCEEDS_STOCK' end as status
       from ask_favorites f left join shop_customer c using (customer_id) left join shop_product p using (product_id)
       left join wanted_walk w on w.seq = f.seq""",
    _favorites,
)
_registrations = """
    valid as (
        select *, row_number() over (partition by username order by seq) as n from ask_registrations
        where first_name is not null and username not in (select c_name from customer)),
    fresh as (
        select *, (select max(c_custkey) from customer) + row_number() over (order by seq) as customer_id from valid where n = 1)"""
add(
    "register_customers",
    """select customer_id, first_name, last_name, username, wallet_balance from shop_customer
       union all select customer_id, first_name, last_name, username, 0 from fresh""",
    _registrations,
)
add(
    "register_customers_log",
    """select a.seq, case when f.seq is not null then 'DONE' else
                 concat_ws(',', case when a.first_name is null then 'not_null:first_name' end,
                           case when a.username in (select c_name from customer) or v.n > 1 then 'unique:username' end) end as status,
              f.customer_id
       from ask_registrations a left join valid v using (seq) left join fresh f on f.seq = a.seq""",
    _registrations,
)
add(
    "add_phone_numbers",
    """select customer_id, cast(1 as bigint) as position, phone_numbers[1] as phone from shop_customer
       union all
       select customer_id, 1 + row_number() over (partition by customer_id order by seq), phone
       from ask_phones where customer_id in (select customer_id from shop_customer)""",
)
add(
    "phone_arrays",
    """select customer_id, array_to_string(list_concat(phone_numbers, coalesce(l, [])), ',') as phone_numbers
       from shop_customer left join (select customer_id, list(phone order by seq) as l from ask_phones group by customer_id)
       using (customer_id)""",
)
_changes = """
    patch as (
        select username, arg_max(first_name, seq) filter (where first_name is not null) as f,
               arg_max(last_name, seq) filter (where last_name is not null) as l,
               arg_max(phone_numbers, seq) filter (where phone_numbers is not null) as p
        from ask_changes group by username)"""
add(
    "update_customers",
    """select customer_id, coalesce(f, first_name) as first_name, coalesce(l, last_name) as last_name, username,
              array_to_string(coalesce(p, phone_numbers), ',') as phone_numbers
       from shop_customer left join patch using (username)""",
    _changes,
)
add(
    "update_customers_log",
    """select seq, username, case when username not in (select c_name from customer) then 'UNKNOWN_CUSTOMER'
                 when first_name is null and last_name is null and phone_numbers is null then 'NO_FIELDS' else 'DONE' end as status
       from ask_changes""",
)
_orders = """
    wanted as (
        select seq, order_id, product_id, l.quantity, p.stock_count as stock
        from ask_placed join ask_order_lines l using (seq) join shop_product p using (product_id)),""" + GREEDY.format(
    source="wanted"
)
add(
    "create_orders",
    f"""select order_id, customer_id, address_id, status, cast(total_price as {MONEY}) as total_price from shop_order
       union all
       select o.order_id, o.customer_id, o.address_id, false,
              cast(coalesce(sum(case when w.accepted then w.quantity * p.price end), 0) as {MONEY})
       from ask_placed o left join wanted_walk w using (seq) left join shop_product p on p.product_id = w.product_id
       group by o.order_id, o.customer_id, o.address_id""",
    _orders,
)
add(
    "create_orders_log",
    """select w.seq, o.order_id, w.product_id, case when w.accepted then 'DONE' else 'EXCEEDS_STOCK' end as status
       from wanted_walk w join ask_placed o using (seq)
       union all select seq, null, null, refused from ask_orders where refused is not null""",
    _orders,
)
add(
    "create_orders_stock",
    """select p.product_id, cast(p.stock_count - coalesce(sum(w.quantity) filter (where w.accepted), 0) as int) as stock_count
       from shop_product p left join wanted_walk w on w.product_id = p.product_id group by p.product_id, p.stock_count""",
    _orders,
)
add(
    "create_orders_items",
    """select quantity, order_id, product_id from shop_items
       union all
       select w.quantity, o.order_id, w.product_id from wanted_walk w join ask_placed o using (seq) where w.accepted""",
    _orders,
)
add(
    "create_orders_arrays",
    """select w.seq, o.order_id, w.product_id, case when w.accepted then 'DONE' else 'EXCEEDS_STOCK' end as status
       from wanted_walk w join array_placed o using (seq)
       union all select seq, null, null, refused from array_orders where refused is not null""",
    """
    wanted as (
        select seq, order_id, product_id, l.quantity, p.stock_count as stock
        from array_placed join ask_order_lines l using (seq) join shop_product p using (product_id)),""" + GREEDY.format(source="wanted"),
)
_tries = """
    tries as (
        select o_orderkey * 4 + i as seq, o_orderkey as order_id, i, (case i % 2 when 0 then '{first}' else '{second}' end) || o_orderkey as code
        from orders cross join (values (0), (1), (2), (3)) v(i)),
    judged as (
        select t.*, case when d.code is null then 'NOT_AVAILABLE' when d.status and i < 2 then 'APPLIED' else 'INACTIVE' end as status
        from tries t left join {codes} d on d.code = t.code and d.order_id = t.order_id)"""
_discount_tries = _tries.format(first="D", second="E", codes="all_discounts")
add(
    "apply_discounts",
    f"""select order_id, cast(case when p2 is null then once else ((once * (10000 - p2)) * 2 + 10000) // 20000 end / 100.0 as {MONEY})
              as total_price
       from (select order_id, p2, case when p1 is null then cents else ((cents * (10000 - p1)) * 2 + 10000) // 20000 end as once
             from (select o.order_id, cast(o.total_price * 100 as bigint) as cents, cast(d.percentage * 100 as bigint) as p1,
                          cast(e.percentage * 100 as bigint) as p2
                   from shop_order o left join all_discounts d on d.order_id = o.order_id and d.status and d.code = 'D' || o.order_id
                   left join all_discounts e on e.order_id = o.order_id and e.code = 'E' || o.order_id))""",
)
add("apply_discounts_log", "select seq, order_id, code, status from judged", _discount_tries)
add(
    "apply_discounts_codes",
    "select discount_id, code, false as status, order_id, percentage from all_discounts",
)
_gift_tries = _tries.format(first="G", second="H", codes="all_gifts")
add(
    "apply_gift_cards",
    f"""select o.order_id, cast(o.total_price - coalesce(sum(g.value), 0) as {MONEY}) as total_price
       from shop_order o left join all_gifts g on g.order_id = o.order_id and g.status group by o.order_id, o.total_price""",
)
add("apply_gift_cards_log", "select seq, order_id, code, status from judged", _gift_tries)
add("apply_gift_cards_codes", "select gift_id, code, false as status, order_id from all_gifts")
for _name, _id in (("discounts", "discount_id, code, status and order_id % 3 <> 1 as status, order_id, percentage"), ("gifts", "gift_id, code, status and order_id % 3 <> 1 as status, order_id")):
    add(f"apply_{'discounts' if _name == 'discounts' else 'gift_cards'}_unrequested", f"select {_id} from all_{_name}")
_left = {
    "customer": ("shop_customer", "customer_id", "customer_id not in (from leaving)"),
    "address": ("shop_address", "address_id", "customer_id not in (from leaving)"),
    "review": ("shop_review", "review_id", "customer_id not in (from leaving)"),
    "favorite_list": ("shop_list", "favorite_id", "customer_id not in (from leaving)"),
    "favorite_list_items": (
        "shop_list_items",
        "favorite_id",
        "favorite_id not in (select favorite_id from shop_list where customer_id in (from leaving))",
    ),
    "order": ("shop_order", "order_id", "customer_id not in (from leaving)"),
    "payment": ("shop_payment", "payment_id", "customer_id not in (from leaving)"),
    "order_items": ("shop_items", "order_id", "order_id not in (select order_id from shop_order where customer_id in (from leaving))"),
    "discount_code": ("shop_discount", "discount_id", "order_id not in (select order_id from shop_order where customer_id in (from leaving))"),
    "gift_card": ("shop_gift", "gift_id", "order_id not in (select order_id from shop_order where customer_id in (from leaving))"),
}
_columns = {
    "customer": "customer_id, first_name, last_name, username",
    "address": "address_id, customer_id",
    "category": "category_id, name",
    "product": "product_id, name, price, stock_count, category_id",
    "review": "review_id, rating, customer_id, product_id",
    "favorite_list": "favorite_id, customer_id",
    "favorite_list_items": "favorite_id, product_id, quantity",
    "order": "order_id, order_date, total_price, status, customer_id",
    "payment": "payment_id, amount, payment_date, order_id, customer_id",
    "order_items": "order_id, product_id, quantity",
    "discount_code": "discount_id, code, percentage, status, order_id",
    "gift_card": "gift_id, code, value, status, order_id",
}
for _name, (_source, _key, _rule) in _left.items():
    add(f"delete_customers_{_name}", f"select {_columns[_name]} from {_source} where {_rule}")
# Table: (source, id columns, a column that refers to another table and is spoilt, unique columns besides).
_seeds = {
    "customer": ("shop_customer", "customer_id", None, "username"),
    "address": ("shop_address", "address_id", "customer_id", None),
    "category": ("shop_category", "category_id", None, None),
    "product": ("shop_product", "product_id", "category_id", None),
    "favorite_list": ("shop_list", "favorite_id", "customer_id", "customer_id"),
    "favorite_list_items": ("shop_list_items", "favorite_id, product_id", None, None),
    "order": ("shop_order", "order_id", "customer_id", None),
    "payment": ("shop_payment", "payment_id", "order_id", None),
    "order_items": ("shop_items", "order_id, product_id", None, None),
    "discount_code": ("shop_discount", "discount_id", "order_id", "code"),
    "gift_card": ("shop_gift", "gift_id", "order_id", "code"),
}
_refused = []
for _name, (_source, _ids, _reference, _other) in _seeds.items():
    add(f"ingest_{_name}", f"select {_columns[_name]} from {_source}")
    _counts = [(f"unique:{_key.replace(', ', ',')}", "count(*) // 10") for _key in (_ids, _other) if _key]
    _counts.append((f"type:{_ids.split(',')[0]}", "count(*) // 15 - count(*) // 30" if _reference else "count(*) // 15"))
    if _reference:
        _counts.append((f"foreign_key:{_reference}", "count(*) // 30"))
    _refused += [f"select '{_name}' as table_name, '{_reason}' as reason, {_n} as n_rows from {_source} having {_n} > 0" for _reason, _n in _counts]
add("ingest_seed_rejects", " union all ".join(_refused))
add(
    "delete_customers",
    " union all ".join(
        f"select '{name}' as table_name, cast(count(*) as bigint) as n_rows, cast(sum({key}) as bigint) as key_sum "
        f"from {source} where {rule}"
        for name, (source, key, rule) in _left.items()
    ),
)

# ---- derived values -----------------------------------------------------------------------------
add(
    "favorite_totals",
    f"""select f.favorite_id, f.customer_id, cast(coalesce(sum(i.quantity * p.price), 0) as {MONEY}) as total_price
       from shop_list f left join shop_list_items i using (favorite_id) left join shop_product p using (product_id)
       group by f.favorite_id, f.customer_id""",
)
add(
    "order_totals",
    f"""select o.order_id, cast(coalesce(sum(i.quantity * p.price), o.total_price) as {MONEY}) as total_price
       from shop_order o left join shop_items i using (order_id) left join shop_product p using (product_id)
       group by o.order_id, o.total_price""",
)
add(
    "validate_order_address",
    """select seq as order_id, customer_id, address_id,
              exists (select 1 from shop_address a where a.address_id = o.address_id and a.customer_id = o.customer_id) as accepted
       from ask_orders o""",
)
_progress = f"""
    progress as (
        select p.payment_id, p.order_id, p.amount, o.total_price,
               cast(sum(p.amount) over (partition by p.order_id order by p.payment_id) as {MONEY}) as paid_so_far
        from shop_payment p join shop_order o using (order_id))"""
add("payment_progress", "select *, paid_so_far >= total_price as covers from progress", _progress)
add(
    "payment_progress_status",
    f"""select p.payment_id, p.order_id, p.amount, case when p.order_id % 9 <> 0 then o.total_price end as total_price,
              cast(sum(p.amount) over (partition by p.order_id order by p.payment_id) as {MONEY}) as paid_so_far,
              coalesce(sum(p.amount) over (partition by p.order_id order by p.payment_id)
                       >= case when p.order_id % 9 <> 0 then o.total_price end, false) as covers
       from shop_payment p join shop_order o using (order_id)""",
)
add(
    "payment_settlement",
    f"""select order_id, total_price, cast(sum(amount) as {MONEY}) as total_paid, bool_or(paid_so_far >= total_price) as paid,
              min(payment_id) filter (where paid_so_far >= total_price) as settled_by,
              cast(min(paid_so_far) filter (where paid_so_far >= total_price) - total_price as {MONEY}) as excess
       from progress group by order_id, total_price""",
    _progress,
)
_wallet = """
    numbered as (
        select p.payment_id, p.customer_id, p.order_id, cast(p.amount * 100 as bigint) as amount,
               cast(o.total_price * 100 as bigint) as total, cast(c.wallet_balance * 100 as bigint) as wallet,
               row_number() over (partition by p.customer_id order by p.payment_date, p.payment_id) as n
        from shop_payment p join shop_order o using (order_id) join shop_customer c on c.customer_id = p.customer_id
        where o.customer_id = p.customer_id),
    walk as (
        select payment_id, customer_id, order_id, n, amount + wallet >= total as order_paid,
               case when amount + wallet >= total then amount else amount + wallet end as stored,
               case when amount + wallet > total then amount + wallet - total when amount + wallet = total then wallet else 0 end
                   as wallet_after,
               map([order_id], [case when amount + wallet >= total then amount else amount + wallet end]) as sums
        from numbered where n = 1
        union all
        select payment_id, customer_id, order_id, n, funds >= total, case when funds >= total then amount else funds end,
               case when funds > total then funds - total when funds = total then wallet_before else 0 end,
               map_concat(sums, map([order_id], [before + case when funds >= total then amount else funds end]))
        from (select r.payment_id, r.customer_id, r.order_id, r.n, r.amount, r.total, w.wallet_after as wallet_before, w.sums,
                     coalesce(w.sums[r.order_id], 0) as before,
                     coalesce(w.sums[r.order_id], 0) + r.amount + w.wallet_after as funds
              from walk w join numbered r on r.customer_id = w.customer_id and r.n = w.n + 1))"""
add(
    "wallet_ledger",
    f"""select payment_id, customer_id, order_id, order_paid, cast(stored / 100.0 as {MONEY}) as stored_amount,
              cast(wallet_after / 100.0 as {MONEY}) as wallet_after, cast(sums[order_id] / 100.0 as {MONEY}) as paid_sum
       from walk""",
    _wallet,
)
_known = _wallet.replace("where o.customer_id = p.customer_id", "where o.customer_id = p.customer_id and o.order_id % 9 <> 0 and c.customer_id % 10 <> 0")
add(
    "wallet_ledger_status",
    f"""select payment_id, customer_id, order_id, order_paid, cast(stored / 100.0 as {MONEY}) as stored_amount,
              cast(wallet_after / 100.0 as {MONEY}) as wallet_after, cast(sums[order_id] / 100.0 as {MONEY}) as paid_sum,
              case when order_paid then 'PAID' else 'OPEN' end as status
       from walk
       union all
       select payment_id, customer_id, order_id, false, cast(amount as {MONEY}), cast(null as {MONEY}), cast(null as {MONEY}),
              case when order_id % 9 = 0 then 'UNKNOWN_ORDER' else 'UNKNOWN_CUSTOMER' end
       from shop_payment where order_id % 9 = 0 or customer_id % 10 = 0""",
    _known,
)
add("settled_orders", "select order_id, status or order_id in (select order_id from walk where order_paid) as status from shop_order", _wallet)
add(
    "settled_wallets",
    f"""select customer_id, cast(coalesce(w / 100.0, wallet_balance) as {MONEY}) as wallet_balance
       from shop_customer left join (select customer_id, arg_max(wallet_after, n) as w from walk group by customer_id) using (customer_id)""",
    _wallet,
)
add(
    "settled_payments",
    f"select payment_id, cast(coalesce(stored / 100.0, amount) as {MONEY}) as amount from shop_payment left join walk using (payment_id)",
    _wallet,
)
_shared = """
    numbered as (
        select p.payment_id, p.payer as customer_id, p.order_id, cast(p.amount * 100 as bigint) as amount,
               cast(o.total_price * 100 as bigint) as total, cast(c.wallet_balance * 100 as bigint) as wallet,
               p.payer // 2 as pair, row_number() over (partition by p.payer // 2 order by p.payment_date, p.payment_id) as n
        from (select *, case when payment_id - order_id * 3 = 1 then xor(customer_id, 1) else customer_id end as payer
              from shop_payment) p
        join shop_order o using (order_id) join shop_customer c on c.customer_id = p.payer),
    walk as (
        select payment_id, customer_id, order_id, pair, n, amount + wallet >= total as order_paid,
               case when amount + wallet >= total then amount else amount + wallet end as stored,
               case when amount + wallet > total then amount + wallet - total when amount + wallet = total then wallet else 0 end
                   as wallet_after,
               map([order_id], [case when amount + wallet >= total then amount else amount + wallet end]) as sums,
               map([customer_id], [case when amount + wallet > total then amount + wallet - total
                                        when amount + wallet = total then wallet else 0 end]) as wallets
        from numbered where n = 1
        union all
        select payment_id, customer_id, order_id, pair, n, funds >= total, case when funds >= total then amount else funds end,
               case when funds > total then funds - total when funds = total then wallet_before else 0 end,
               map_concat(sums, map([order_id], [before + case when funds >= total then amount else funds end])),
               map_concat(wallets, map([customer_id],
                   [case when funds > total then funds - total when funds = total then wallet_before else 0 end]))
        from (select *, before + amount + wallet_before as funds
              from (select r.payment_id, r.customer_id, r.order_id, r.pair, r.n, r.amount, r.total, w.sums, w.wallets,
                           coalesce(w.wallets[r.customer_id], r.wallet) as wallet_before,
                           coalesce(w.sums[r.order_id], 0) as before
                    from walk w join numbered r on r.pair = w.pair and r.n = w.n + 1)))"""
add(
    "wallet_ledger_shared",
    f"""select payment_id, customer_id, order_id, order_paid, cast(stored / 100.0 as {MONEY}) as stored_amount,
              cast(wallet_after / 100.0 as {MONEY}) as wallet_after, cast(sums[order_id] / 100.0 as {MONEY}) as paid_sum
       from walk""",
    _shared,
)
_ratings = f"""
    rated as (select product_id, cast({MEAN2} as decimal(5,2)) as mean from shop_review group by product_id)"""
add(
    "product_ratings",
    """select p.product_id, case when r.product_id is null then p.rating else r.mean end as rating
       from shop_product p left join rated r using (product_id)""",
    _ratings,
)
_stock = """
    wanted as (
        select order_id as seq, product_id, quantity, stock_count as stock from shop_items join shop_product using (product_id)),""" + GREEDY.format(
    source="wanted"
)
add("allocate_stock", "select product_id, seq as order_id, quantity, accepted from wanted_walk", _stock)
add(
    "allocate_stock_status",
    """select a.seq, a.product_id, a.quantity, coalesce(w.accepted, false) as accepted,
              case when a.product_id is null then 'NO_PRODUCT' when a.product_id >= 1000000000 then 'UNKNOWN_PRODUCT'
                   when a.quantity is null then 'NO_QUANTITY' when w.accepted then 'DONE' else 'EXCEEDS_STOCK' end as status
       from ask_stock a left join wanted_walk w on w.seq = a.seq and w.product_id = a.product_id""",
    """
    wanted as (
        select seq, product_id, quantity, stock_count as stock from ask_stock join shop_product using (product_id)
        where quantity is not null),""" + GREEDY.format(source="wanted"),
)
add(
    "allocate_stock_remaining",
    """select product_id, list_reduce(list_prepend(stock, list(quantity order by seq)),
                  lambda a, x: case when x > a then a else a - x end) as stock_count
       from wanted group by product_id, stock""",
    "wanted as (select order_id as seq, product_id, quantity, stock_count as stock from shop_items join shop_product using (product_id))",
)
add(
    "review_notifications",
    """select review_id, product_id, customer_id, case when rating is null then 'comment' when comment is null then 'rating' else 'both' end as kind,
              case when rating is null then 'new review added for product ' || product_id || ' by customer :' || customer_id || ' comment :' || comment || ' '
                   when comment is null then 'new review added for product ' || product_id || ' by customer :' || customer_id || ' rating :' || rating || ' '
                   else 'new review added for product ' || product_id || ' by customer :' || customer_id || ' rating :' || rating || ' comment :' || comment || ' '
              end as message
       from shop_review""",
)
add(
    "order_history",
    """select row_number() over (order by o.order_id) as log_id, o.customer_id, o.order_id,
              '{"order_date":"' || strftime(o.order_date, '%Y-%m-%dT%H:%M:%S.000') || '","total_price":' || o.total_price
              || ',"status":true,"items":' || coalesce(items, 'null') || '}' as order_details,
              timestamp '2002-01-01' as logged_at
       from shop_order o left join (
         select order_id, '[' || string_agg('{"product_id":' || product_id || ',"quantity":' || quantity || ',"price":' || price || '}',
                ',' order by product_id) || ']' as items
         from shop_items join shop_product using (product_id) group by order_id) i on i.order_id = o.order_id
       where o.status""",
)
SQL["history_sink"] = SQL["order_history"]

# ---- data quality -------------------------------------------------------------------------------
DEFINITIONS.update(
    {
        "un_customer": """
            select customer_id, case when customer_id % 10 <> 3 then first_name end as first_name, last_name,
                   'u' || substring(username, 16, 3) as username, cast(wallet_balance as decimal(18,2)) * 20000 as wallet_balance
            from shop_customer""",
        "un_product": """
            select p_partkey as product_id, repeat(p_name, p_size) as name, cast(p_retailprice as decimal(10,2)) as price,
                   p_size - 5 as stock_count, 1 + p_partkey % 14 as category_id
            from part""",
        "un_review": """
            select event_id as review_id, case when event_id % 3 <> 0 then event_id % 8 end as rating,
                   case when event_id % 2 = 0 then props end as comment, user_id as customer_id,
                   cast(props->>'$.k' as bigint) * 30 as product_id
            from events where event_type = 'view'""",
        "un_order": "select * replace (address_id + 1 as address_id) from shop_order",
        "un_items": "select cast(l_quantity as int) as quantity, l_orderkey as order_id, l_partkey as product_id from lineitem",
        "un_discount": """
            select o_orderkey as discount_id, 'D' || o_orderkey % 1000 as code, cast(o_orderkey % 130 as decimal(5,2)) as percentage,
                   o_orderkey % 20 = 0 as status, o_orderkey as order_id
            from orders where o_orderkey % 10 = 0""",
        "un_log": """
            select cast(null as bigint) as log_id, cast(null as bigint) as customer_id, cast(null as bigint) as order_id,
                   '' as order_details, now() as logged_at where false""",
    }
)
# table -> (source, required columns, unique keys, references, text lengths)
_RULES = {
    "customer": ("un_customer", "customer_id first_name last_name username", ["customer_id", "username"], {},
                 {"first_name": 100, "last_name": 100, "username": 30}),
    "address": ("shop_address", "address_id street_name street_number country city postal_code province customer_id",
                ["address_id"], {"customer_id": "customer"},
                {"street_name": 50, "street_number": 30, "country": 30, "city": 30, "postal_code": 30, "province": 30}),
    "category": ("shop_category", "category_id name", ["category_id"], {}, {"name": 50}),
    "product": ("un_product", "product_id name price", ["product_id"], {"category_id": "category"}, {"name": 100}),
    "review": ("un_review", "review_id customer_id product_id", ["review_id"],
               {"customer_id": "customer", "product_id": "product"}, {}),
    "favorite_list": ("shop_list", "favorite_id create_date customer_id", ["favorite_id", "customer_id"],
                      {"customer_id": "customer"}, {}),
    "favorite_list_items": ("shop_list_items", "favorite_id product_id quantity", ["favorite_id,product_id"],
                            {"favorite_id": "favorite_list", "product_id": "product"}, {}),
    "order": ("un_order", "order_id order_date status customer_id address_id", ["order_id"],
              {"customer_id": "customer", "address_id": "address"}, {}),
    "payment": ("shop_payment", "payment_id amount method payment_date order_id customer_id", ["payment_id"],
                {"order_id": "order", "customer_id": "customer"}, {"method": 30}),
    "order_items": ("un_items", "quantity order_id product_id", ["order_id,product_id"],
                    {"order_id": "order", "product_id": "product"}, {}),
    "discount_code": ("un_discount", "discount_id code percentage status order_id", ["discount_id", "code"],
                      {"order_id": "order"}, {"code": 30}),
    "gift_card": ("shop_gift", "gift_id value code status order_id", ["gift_id", "code"], {"order_id": "order"}, {"code": 30}),
    "order_history_log": ("un_log", "log_id customer_id order_id order_details logged_at", ["log_id"],
                          {"customer_id": "customer", "order_id": "order"}, {}),
}


def _count(table: str, rule: str, source: str, broken: str) -> str:
    return (
        f"select '{table}' as table_name, '{rule}' as rule, cast(count(*) as bigint) as violations from {source} where {broken}"
    )


def _all(parts: list[str]) -> str:
    return " union all ".join(parts)


add(
    "dq_not_null",
    _all([_count(t, f"not_null:{c}", src, f"{c} is null") for t, (src, cols, *_) in _RULES.items() for c in cols.split()]),
)
add(
    "dq_unique",
    _all(
        [
            f"select '{t}' as table_name, 'unique:{key}' as rule, cast(coalesce(sum(n - 1), 0) as bigint) as violations "
            f"from (select count(*) as n from {src} group by {key} having count(*) > 1)"
            for t, (src, _, keys, _, _) in _RULES.items()
            for key in keys
        ]
    ),
)
add(
    "dq_foreign_keys",
    _all(
        [
            _count(
                t,
                f"foreign_key:{column}->{parent}",
                f"{src} child",
                f"{column} is not null and not exists (select 1 from {_RULES[parent][0]} parent "
                f"where parent.{_RULES[parent][2][0]} = child.{column})",
            )
            for t, (src, _, _, refs, _) in _RULES.items()
            for column, parent in refs.items()
        ]
    ),
)
add(
    "dq_checks",
    _all(
        [
            _count("product", "check:stock_not_negative", "un_product", "stock_count <= -1"),
            _count("review", "check:rating_1_to_5", "un_review", "rating < 1 or rating > 5"),
            _count("review", "check:comment_or_rating", "un_review", "comment is null and rating is null"),
            _count("discount_code", "check:percentage_0_to_100", "un_discount", "percentage < 0 or percentage > 100"),
        ]
    ),
)
add(
    "dq_domain",
    _all(
        [
            _count(t, f"length:{c}", src, f"length({c}) > {n}")
            for t, (src, _, _, _, lengths) in _RULES.items()
            for c, n in lengths.items()
        ]
        + [_count("customer", "range:wallet_balance", "un_customer", "abs(wallet_balance) >= 100000000")]
    ),
)

_CHECKS = [
    ("product", "check:stock_not_negative", "un_product", "stock_count <= -1"),
    ("review", "check:rating_1_to_5", "un_review", "rating < 1 or rating > 5"),
    ("review", "check:comment_or_rating", "un_review", "comment is null and rating is null"),
    ("discount_code", "check:percentage_0_to_100", "un_discount", "percentage < 0 or percentage > 100"),
    ("customer", "range:wallet_balance", "un_customer", "abs(wallet_balance) >= 100000000"),
]


def _found(table: str, rule: str, source: str, broken: str, value: str, distinct: str = "") -> str:
    text = f"concat_ws(',', {value})"
    return f"select '{table}' as table_name, '{rule}' as rule, count({distinct} {text}) as found, min({text}) as first from {source} where {broken}"


def _groups(source: str, key: str) -> str:
    some = " and ".join(f"{c} is not null" for c in key.split(","))
    return f"(select {key} from {source} where {some} group by {key} having count(*) > 1)"


add(
    "violating_keys",
    "select * from ("
    + _all(
        [_found(t, f"not_null:{c}", src, f"{c} is null", keys[0]) for t, (src, cols, keys, _, _) in _RULES.items() for c in cols.split()]
        + [_found(t, rule, src, broken, _RULES[t][2][0]) for t, rule, src, broken in _CHECKS]
        + [_found(t, f"length:{c}", src, f"length({c}) > {n}", keys[0]) for t, (src, _, keys, _, lengths) in _RULES.items() for c, n in lengths.items()]
        + [_found(t, f"unique:{key}", _groups(src, key), "true", key) for t, (src, _, keys, _, _) in _RULES.items() for key in keys]
        + [
            _found(
                t, f"foreign_key:{column}->{parent}", f"{src} child",
                f"{column} is not null and not exists (select 1 from {_RULES[parent][0]} parent "
                f"where parent.{_RULES[parent][2][0]} = child.{column})", column, "distinct",
            )
            for t, (src, _, _, refs, _) in _RULES.items()
            for column, parent in refs.items()
        ]
    )
    + ") where found > 0",
)

# ---- streams ------------------------------------------------------------------------------------
SQL["stream_order_totals"] = SQL["order_totals"]
SQL["stream_order_totals_late_products"] = SQL["order_totals"]
SQL["stream_favorite_totals"] = SQL["favorite_totals"]
add("stream_product_ratings", "select product_id, mean as rating from rated", _ratings)
SQL["stream_stock_gate"] = SQL["allocate_stock"]
SQL["stream_stock_gate_status"] = SQL["allocate_stock_status"]
_sold = """
    ends as (select min(l_orderkey) as low, max(l_orderkey) as high from lineitem),
    sold as (
        select o_orderdate as order_date, l_partkey as product_id, cast(l_quantity as int) as quantity,
               case when l_orderkey < low + (high - low) // 3 then 0 when l_orderkey < low + (high - low) * 2 // 3 then 1 else 2 end as batch
        from lineitem join orders on o_orderkey = l_orderkey cross join ends),
    judged as (
        select date_trunc('day', order_date) as day, product_id, quantity,
               coalesce(date_trunc('day', order_date) + interval 1 day <= seen - interval 30 days, false) as late
        from sold join (select batch, lag(upto) over (order by batch) as seen from (
            select distinct batch, max(order_date) over (order by batch) as upto from sold)) using (batch))"""
for _name, _which in (("late", "late"), ("on_time", "not late")):
    add(
        f"stream_daily_sales_{_name}",
        f"select product_id, cast(day as timestamp) as day, cast(sum(quantity) as bigint) as units from judged where {_which} group by product_id, day",
        _sold,
    )
add(
    "stream_dated_items",
    """select l_orderkey as order_id, l_partkey as product_id, cast(l_quantity as bigint) as quantity, 1 as sign, o_orderdate as order_date
       from lineitem join orders on o_orderkey = l_orderkey""",
)
SQL["stream_wallet_ledger"] = SQL["wallet_ledger"]
SQL["stream_wallet_ledger_shared"] = SQL["wallet_ledger_shared"]
add(
    "stream_wallet_ledger_status",
    f"""select payment_id, customer_id, order_id, order_paid, cast(stored / 100.0 as {MONEY}) as stored_amount,
              cast(wallet_after / 100.0 as {MONEY}) as wallet_after, cast(sums[order_id] / 100.0 as {MONEY}) as paid_sum,
              case when order_paid then 'PAID' else 'OPEN' end as status
       from walk
       union all
       select payment_id, customer_id, order_id, false, cast(amount as {MONEY}), cast(null as {MONEY}), cast(null as {MONEY}), 'UNKNOWN_ORDER'
       from shop_payment where order_id % 9 = 0""",
    _wallet.replace("where o.customer_id = p.customer_id", "where o.customer_id = p.customer_id and o.order_id % 9 <> 0"),
)
add(
    "stream_order_address_check",
    """select o_orderkey as order_id, o_custkey as customer_id, o_custkey * 4 + o_orderkey % 4 as address_id,
              o_orderkey % 4 <= o_custkey % 3 as accepted from orders""",
)
SQL["stream_review_notifications"] = SQL["review_notifications"]
SQL["stream_order_history"] = SQL["order_history"]
SQL["stream_order_history_once"] = SQL["order_history"]
SQL["stream_daily_sales"] = SQL["monthly_report"]
