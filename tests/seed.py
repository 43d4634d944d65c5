"""The example shop: numbers from FIXTURES.md section 2."""

from datetime import datetime
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tradepost.sources import TABLES, Tables

NOW = datetime(2024, 11, 19, 12, 0)

CATEGORIES = {1: "Tools", 2: "Beauty", 3: "Health", 4: "Electronics", 5: "Beauty", 6: "Movies", 7: "Outdoors", 8: "Shoes", 9: "Movies", 10: "Shoes"}
PRODUCTS = """76.69,19,1 90.20,10,5 87.27,3,2 37.56,7,3 90.59,7,4 81.48,9,1 93.45,17,9 82.08,14,9 22.57,15,2 73.73,17,3
50.77,1,7 94.23,9,6 61.00,5,3 42.35,5,9 17.93,1,3 42.11,1,5 38.42,7,6 13.60,19,7 57.24,3,1 20.35,2,3""".split()
ORDERS = [(13, 9), (17, 1), (6, 13), (14, 16), (5, 22), (16, 6), (14, 16), (6, 8)]
ITEMS = """12,3,1 2,15,4 2,17,1 15,3,7 13,14,3 3,14,6 10,9,1 14,5,4 8,10,3 8,11,7 5,2,7 19,13,7 4,18,8 11,2,5 5,12,2 2,9,4
11,4,2 11,4,1 11,6,1 1,8,5""".split()
REVIEWS = [(None, 17, 12), (None, 13, 10), (2, 7, 14), (None, 5, 20), (4, 14, 10), (2, 19, 1), (3, 16, 19), (None, 25, 20), (None, 5, 8), (3, 17, 7)]
LISTS = [15, 24, 22, 23, 13, 17, 20, 4, 25, 1, 16, 14, 19]
LIST_ITEMS = """1,1,26 8,10,15 3,20,12 8,14,1 9,19,16 1,3,14 12,3,15 13,10,11 10,19,19 8,20,10 7,13,14 10,16,9 9,17,17""".split()
PAYMENTS = "26.10,9,1 63.17,19,3 86.09,20,2 39.60,3,5 50.33,22,8 21.20,2,4 17.36,11,7 1.77,16,6".split()
OWNERS = {1: 17, 2: 17, 6: 16, 8: 6, 9: 13, 13: 6, 16: 14, 22: 5}


def _numbers(text):
    return [int(x) for x in text.split(",")]


def seed_rows():
    cents = Decimal("0.00")
    products = [p.split(",") for p in PRODUCTS]
    payments = [p.split(",") for p in PAYMENTS]
    return {
        "customer": [(i, f"First{i}", f"Last{i}", f"user{i}", cents, [f"{i}-1"]) for i in range(1, 26)],
        "address": [
            (i, "Main", "1", "Land", "Gongpo" if i == 6 else f"City{i}", "1", "State", OWNERS.get(i, 25)) for i in range(1, 26)
        ],
        "category": list(CATEGORIES.items()),
        "product": [
            (i, f"Product{i}", Decimal(price), int(stock), int(category), cents)
            for i, (price, stock, category) in enumerate(products, 1)
        ],
        "review": [
            (i, rating, None if i == 10 else f"text {i}", customer, product)
            for i, (rating, customer, product) in enumerate(REVIEWS, 1)
        ],
        "favorite_list": [(i, cents, NOW, customer) for i, customer in enumerate(LISTS, 1)],
        "favorite_list_items": [tuple(_numbers(x)) for x in LIST_ITEMS],
        "order": [(i, NOW, cents, False, customer, address) for i, (customer, address) in enumerate(ORDERS, 1)],
        "payment": [
            (i, Decimal(amount), "card", NOW, int(order), int(payer)) for i, (amount, payer, order) in enumerate(payments, 1)
        ],
        "order_items": [(q, o, p) for q, p, o in map(_numbers, ITEMS)],
        "discount_code": [(1, "D1", Decimal(10), True, 1), (2, "D4", Decimal(20), True, 4)],
        "gift_card": [
            (1, Decimal("36.72"), "G1", True, 1),
            (2, Decimal("23.24"), "G4", False, 4),
            (3, Decimal("5.08"), "G3", False, 3),
            (4, Decimal("38.84"), "G7", True, 7),
        ],
        "order_history_log": [],
    }


def frame(spark, rows, schema):
    """A DataFrame of known small size, so that joins broadcast it as they would a small file."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    table = pa.Table.from_pylist([dict(zip(schema.fieldNames(), r)) for r in rows], to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


def tables_of(spark, rows):
    def build(name):
        return lambda: frame(spark, rows[name], TABLES[name].schema)

    return Tables(spark, {name: build(name) for name in rows})


def seed_tables(spark):
    return tables_of(spark, seed_rows())
