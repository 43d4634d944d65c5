import random
from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from seed import frame
from tradepost.functions import durable
from tradepost.functions.groups import linked_groups
from tradepost.operators import derive, wallet
from tradepost.operators.wallet import settle_with_wallet, wallet_ledger

START = datetime(2024, 1, 1)


def ledger(payments, orders, wallets):
    """The rule row by row: (payment, date, customer, order, cents)."""
    stored, wallet, out = {}, dict(wallets), {}
    for payment, date, customer, order, amount in sorted(payments, key=lambda p: (p[1], p[0])):
        total = orders[order]
        funds = stored.get(order, 0) + amount + wallet[customer]
        enough = total is not None and funds >= total
        if enough:
            if funds > total:
                wallet[customer] = funds - total
        else:
            amount, wallet[customer] = funds, 0
        stored[order] = stored.get(order, 0) + amount
        out[payment] = (enough, amount, stored[order], wallet[customer])
    return out, wallet


def money(cents):
    return None if cents is None else Decimal(cents) / 100


def tables(spark, payments, orders, wallets):
    return {
        "payment": frame(
            spark,
            [(p, money(a), "card", d, o, c) for p, d, c, o, a in payments],
            "payment_id bigint, amount decimal(10,2), method string, payment_date timestamp_ntz, order_id bigint, customer_id bigint",
        ),
        "order": frame(
            spark,
            [(o, START, money(t), False, 1, 1) for o, t in orders.items()],
            "order_id bigint, order_date timestamp_ntz, total_price decimal(10,2), status boolean, customer_id bigint, address_id bigint",
        ),
        "customer": frame(
            spark,
            [(c, "a", "b", f"u{c}", money(w), None) for c, w in wallets.items()],
            "customer_id bigint, first_name string, last_name string, username string, wallet_balance decimal(10,2), phone_numbers array<string>",
        ),
    }


def run(spark, payments, orders, wallets):
    rows = wallet_ledger(tables(spark, payments, orders, wallets)).collect()
    cents = lambda x: int(x * 100)
    return {r.payment_id: (r.order_paid, cents(r.stored_amount), cents(r.paid_sum), cents(r.wallet_after)) for r in rows}


def example(seed, n=400, customers=8, shared=False):
    """Customer 1 makes a third of all payments; with ``shared`` some orders have several payers."""
    rng = random.Random(seed)
    orders = {o: None if o % 29 == 0 else rng.randint(100, 900) for o in range(60)}
    payments = []
    for p in range(n):
        customer = 1 if rng.random() < 0.34 else rng.randint(2, customers)
        own = [o for o in orders if o % customers == customer - 1]
        order = rng.choice(list(orders) if shared and rng.random() < 0.1 else own)
        payments.append((p, START + timedelta(minutes=rng.randint(0, 300)), customer, order, rng.randint(1, 500)))
    return payments, orders, {c: rng.choice([0, 0, 150, 1000]) for c in range(1, customers + 1)}


def test_own_orders(spark):
    case = example(1)
    assert run(spark, *case) == ledger(*case)[0]


def test_orders_with_several_payers(spark):
    case = example(2, customers=12, shared=True)
    assert run(spark, *case) == ledger(*case)[0]


@pytest.mark.parametrize("seed, shared", [(3, False), (4, True)])
def test_heavy_customer_is_folded_in_chunks(spark, limits, seed, shared):
    limits.fold_rows = 40
    case = example(seed, n=240, shared=shared)
    assert run(spark, *case) == ledger(*case)[0]


def test_exact_payment_leaves_the_wallet(spark):
    payments = [(1, START, 1, 1, 300)]
    assert run(spark, payments, {1: 500}, {1: 200}) == {1: (True, 300, 300, 200)}


def test_insufficient_payment_takes_the_wallet_and_counts_again(spark):
    payments = [(1, START, 1, 1, 100), (2, START, 1, 1, 100)]
    assert run(spark, payments, {1: 1000}, {1: 50}) == {1: (False, 150, 150, 0), 2: (False, 250, 400, 0)}


def test_tables_afterwards(spark):
    payments, orders, wallets = example(5, n=60)
    t = tables(spark, payments, orders, wallets)
    after = settle_with_wallet(t, wallet_ledger(t))
    expected, left = ledger(payments, orders, wallets)
    assert {r.customer_id: int(r.wallet_balance * 100) for r in after["customer"].collect()} == left
    paid = {p[3] for p in payments if expected[p[0]][0]}
    assert {r.order_id for r in after["order"].filter("status").collect()} == paid
    assert {r.payment_id: int(r.amount * 100) for r in after["payment"].collect()} == {p: e[1] for p, e in expected.items()}


def test_linked_groups(spark):
    chain = [(i, i + 1) for i in range(10, 40)]
    star = [(100, i) for i in range(101, 140)]
    links = frame(spark, chain + star + [(7, 5), (5, 6)], "a bigint, b bigint")
    got = {r.node: r.group for r in linked_groups(links).collect()}
    assert got == {**dict.fromkeys(range(10, 41), 10), **dict.fromkeys(range(100, 140), 100), 5: 5, 6: 5, 7: 5}


def test_few_links_are_stored_in_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(durable, "shared_folder", lambda _: str(tmp_path))
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        links = frame(spark, [(i, i + 1) for i in range(300)], "a bigint, b bigint")
        assert {r.group for r in linked_groups(links).collect()} == {0}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
    files = Counter(p.parent for p in tmp_path.rglob("part-*.parquet"))
    assert len(files) > 3 and sorted(files.values())[-2] <= spark.sparkContext.defaultParallelism


def test_every_payment_keeps_a_row(spark):
    payments = [(1, START, 1, 10, 500), (2, START, 1, 99, 700), (3, START, 77, 10, 300), (4, START, 1, 10, 600)]
    t = tables(spark, payments, {10: 1000}, {1: 0})
    got = {r.payment_id: (r.status, r.order_paid, r.stored_amount) for r in wallet.payments_with_status(t).collect()}
    assert {p: s for p, (s, *_) in got.items()} == {1: "OPEN", 2: "UNKNOWN_ORDER", 3: "UNKNOWN_CUSTOMER", 4: "PAID"}
    assert got[2][1:] == (False, 7) and got[3][1:] == (False, 3)
    progress = {r.payment_id: (r.total_price, r.covers) for r in derive.payment_progress(t).collect()}
    assert progress[2] == (None, False) and len(progress) == 4
