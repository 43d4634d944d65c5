import random

import pytest
from pyspark.sql import functions as F

from seed import frame
from tradepost.operators import stock
from tradepost.operators.stock import allocate_stock, remaining_stock


def greedy(requests, stock):
    left, taken = dict(stock), {}
    for seq, product, quantity in sorted(requests):
        ok = left[product] is None or quantity <= left[product]
        if ok and left[product] is not None:
            left[product] -= quantity
        taken[seq, product] = ok
    return taken, left


def run(spark, requests, stock):
    wanted = frame(spark, requests, "seq bigint, product_id bigint, quantity int")
    goods = frame(spark, list(stock.items()), "product_id bigint, stock_count int")
    judged = allocate_stock(wanted, goods)
    taken = {(r.seq, r.product_id): r.accepted for r in judged.collect()}
    left = {r.product_id: r.stock_count for r in remaining_stock(judged, goods).collect()}
    return taken, left


def some_requests(seed, n=600, negative=False, largest=30):
    """A third of all rows ask for product 1."""
    rng = random.Random(seed)
    quantity = (lambda: rng.randint(-3, largest)) if negative else (lambda: rng.randint(1, largest))
    return [(i, 1 if rng.random() < 0.34 else rng.randint(2, 9), quantity()) for i in range(n)]


STOCK = {1: 900, 2: 40, 3: 100, 4: 10**6, 5: None, 6: 0, 7: 333, 8: 500, 9: 71}


@pytest.mark.parametrize("negative", [False, True])
def test_walk(spark, negative):
    requests = some_requests(1, negative=negative)
    assert run(spark, requests, STOCK) == greedy(requests, STOCK)


@pytest.mark.parametrize("negative, seed", [(False, 2), (True, 3)])
def test_long_queues_are_shortened_in_bulk(spark, limits, negative, seed):
    limits.fold_rows, limits.window_rows = 20, 16
    requests = some_requests(seed, n=250, negative=negative)
    assert run(spark, requests, STOCK) == greedy(requests, STOCK)


def test_smaller_request_after_a_skipped_one(spark):
    taken, left = run(spark, [(1, 1, 5), (2, 1, 9), (3, 1, 4), (4, 1, 1)], {1: 10})
    assert taken == {(1, 1): True, (2, 1): False, (3, 1): True, (4, 1): True}
    assert left == {1: 0}


def test_everything_fits(spark):
    requests = some_requests(5)
    plenty = dict.fromkeys(STOCK, 10**6)
    taken, _ = run(spark, requests, plenty)
    assert all(taken.values()) and len(taken) == len(requests)


def test_accepted_never_exceeds_stock(spark, limits):
    limits.fold_rows = 50
    requests = some_requests(6, 900)
    wanted = frame(spark, requests, "seq bigint, product_id bigint, quantity int")
    goods = frame(spark, [(i, 100) for i in range(1, 10)], "product_id bigint, stock_count int")
    judged = allocate_stock(wanted, goods)
    assert judged.count() == len(requests)
    used = judged.filter("accepted").groupBy("product_id").agg(F.sum("quantity").alias("q"))
    assert used.filter("q > 100").count() == 0


def test_every_request_keeps_a_status(spark):
    wanted = frame(spark, [(1, 1, 3), (2, 99, 1), (3, None, 1), (4, 1, None), (5, 1, 9)], "seq bigint, product_id bigint, quantity int")
    goods = frame(spark, [(1, 5)], "product_id bigint, stock_count int")
    got = {r.seq: (r.accepted, r.status) for r in allocate_stock(wanted, goods).collect()}
    refused = {2: (False, "UNKNOWN_PRODUCT"), 3: (False, "NO_PRODUCT"), 4: (False, "NO_QUANTITY"), 5: (False, "EXCEEDS_STOCK")}
    assert got == {1: (True, "DONE"), **refused}


@pytest.mark.parametrize("fold_rows", [7, 20, 90])
@pytest.mark.parametrize("negative", [False, True])
def test_long_queues_by_tables_at_any_chunk_size(spark, limits, monkeypatch, fold_rows, negative):
    limits.fold_rows = fold_rows
    guessed = stock._guessed

    def few(rows):
        assert rows.groupBy("product_id").count().filter(F.col("count") > fold_rows).isEmpty()  # no long queue in one task
        return guessed(rows)

    monkeypatch.setattr(stock, "_guessed", few)
    monkeypatch.setattr(stock, "ROUNDS", 1)  # bulk decisions leave long queues
    requests = some_requests(8, n=300, negative=negative, largest=9)
    assert run(spark, requests, STOCK) == greedy(requests, STOCK)


def test_wide_stock_starts_from_guesses(spark, limits):
    limits.fold_rows, limits.stock_values = 20, 10
    requests = some_requests(9, n=200, negative=True)
    assert run(spark, requests, STOCK) == greedy(requests, STOCK)


def test_negative_opening_stock(spark, limits):
    limits.fold_rows = 5
    rng = random.Random(4)
    requests = [(i, 1, rng.randint(-4, 6)) for i in range(80)]
    assert run(spark, requests, {1: -3}) == greedy(requests, {1: -3})


def test_chunks_are_walked_side_by_side(spark, limits):
    limits.fold_rows = 50
    rows = frame(spark, [(i, 1, i % 7, 20) for i in range(2000)], "seq bigint, product_id bigint, quantity int, _stock bigint")
    walked = stock._walk_long(rows)
    sizes = [r["count"] for r in walked.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 500  # hashing puts several chunks of 25 or so together, never the queue
