"""The thirteen shop tables: columns, keys, references, value rules and defaults.

Ids are 64-bit so that tables can pass two billion rows. The customer's password is not part of
the schema: it is dropped when rows are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
RATE = T.DecimalType(5, 2)
MONEY_SUM = T.DecimalType(18, 2)
ID = T.LongType()
COUNT = T.IntegerType()
TEXT = T.StringType()
FLAG = T.BooleanType()
TIME = T.TimestampNTZType()

ORDER_DETAILS = T.StructType(
    [
        T.StructField("order_date", TIME),
        T.StructField("total_price", MONEY),
        T.StructField("status", FLAG),
        T.StructField(
            "items",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("product_id", ID),
                        T.StructField("quantity", COUNT),
                        T.StructField("price", MONEY),
                    ]
                )
            ),
        ),
    ]
)


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    parent_column: str

    @property
    def name(self) -> str:
        return f"{self.child}.{self.column}->{self.parent}"


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    checks: dict[str, str] = field(default_factory=dict)
    lengths: dict[str, int] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]

    @property
    def unique_keys(self) -> list[tuple[str, ...]]:
        return [self.key, *self.unique]

    @property
    def foreign_keys(self) -> list[ForeignKey]:
        return [
            ForeignKey(self.name, column, parent, parent_column)
            for column, (parent, parent_column) in self.references.items()
        ]


def _columns(*columns) -> T.StructType:
    """``name`` and type, with ``!`` after the name of a required column."""
    return T.StructType(
        [T.StructField(name.rstrip("!"), kind, not name.endswith("!")) for name, kind in columns]
    )


# Table and column names, keys, references, checks, text lengths and defaults.
_SPECS = [
    TableSpec(
        "customer",
        _columns(
            ("customer_id!", ID),
            ("first_name!", TEXT),
            ("last_name!", TEXT),
            ("username!", TEXT),
            ("wallet_balance", MONEY),
            ("phone_numbers", T.ArrayType(TEXT)),
        ),
        key=("customer_id",),
        unique=(("username",),),
        lengths={"first_name": 100, "last_name": 100, "username": 30},
        defaults={"wallet_balance": "0.00"},
    ),
    TableSpec(
        "address",
        _columns(
            ("address_id!", ID),
            ("street_name!", TEXT),
            ("street_number!", TEXT),
            ("country!", TEXT),
            ("city!", TEXT),
            ("postal_code!", TEXT),
            ("province!", TEXT),
            ("customer_id!", ID),
        ),
        key=("address_id",),
        references={"customer_id": ("customer", "customer_id")},
        lengths={
            "street_name": 50,
            "street_number": 30,
            "country": 30,
            "city": 30,
            "postal_code": 30,
            "province": 30,
        },
    ),
    TableSpec(
        "category",
        _columns(("category_id!", ID), ("name!", TEXT)),
        key=("category_id",),
        lengths={"name": 50},
    ),
    TableSpec(
        "product",
        _columns(
            ("product_id!", ID),
            ("name!", TEXT),
            ("price!", MONEY),
            ("stock_count", COUNT),
            ("category_id", ID),
            ("rating", RATE),
        ),
        key=("product_id",),
        references={"category_id": ("category", "category_id")},
        checks={"stock_not_negative": "stock_count > -1"},
        lengths={"name": 100},
        defaults={"rating": "0.00"},
    ),
    TableSpec(
        "review",
        _columns(
            ("review_id!", ID),
            ("rating", COUNT),
            ("comment", TEXT),
            ("customer_id!", ID),
            ("product_id!", ID),
        ),
        key=("review_id",),
        references={
            "customer_id": ("customer", "customer_id"),
            "product_id": ("product", "product_id"),
        },
        checks={
            "rating_1_to_5": "rating >= 1 and rating <= 5",
            "comment_or_rating": "comment is not null or rating is not null",
        },
    ),
    TableSpec(
        "favorite_list",
        _columns(
            ("favorite_id!", ID),
            ("total_price", MONEY),
            ("create_date!", TIME),
            ("customer_id!", ID),
        ),
        key=("favorite_id",),
        unique=(("customer_id",),),
        references={"customer_id": ("customer", "customer_id")},
        defaults={"total_price": "0.00", "create_date": "localtimestamp()"},
    ),
    TableSpec(
        "favorite_list_items",
        _columns(("favorite_id!", ID), ("product_id!", ID), ("quantity!", COUNT)),
        key=("favorite_id", "product_id"),
        references={
            "favorite_id": ("favorite_list", "favorite_id"),
            "product_id": ("product", "product_id"),
        },
    ),
    TableSpec(
        "order",
        _columns(
            ("order_id!", ID),
            ("order_date!", TIME),
            ("total_price", MONEY),
            ("status!", FLAG),
            ("customer_id!", ID),
            ("address_id!", ID),
        ),
        key=("order_id",),
        references={
            "customer_id": ("customer", "customer_id"),
            "address_id": ("address", "address_id"),
        },
        defaults={"order_date": "localtimestamp()", "total_price": "0.00"},
    ),
    TableSpec(
        "payment",
        _columns(
            ("payment_id!", ID),
            ("amount!", MONEY),
            ("method!", TEXT),
            ("payment_date!", TIME),
            ("order_id!", ID),
            ("customer_id!", ID),
        ),
        key=("payment_id",),
        references={
            "order_id": ("order", "order_id"),
            "customer_id": ("customer", "customer_id"),
        },
        lengths={"method": 30},
        defaults={"payment_date": "localtimestamp()"},
    ),
    TableSpec(
        "order_items",
        _columns(("quantity!", COUNT), ("order_id!", ID), ("product_id!", ID)),
        key=("order_id", "product_id"),
        references={
            "order_id": ("order", "order_id"),
            "product_id": ("product", "product_id"),
        },
    ),
    TableSpec(
        "discount_code",
        _columns(
            ("discount_id!", ID),
            ("code!", TEXT),
            ("percentage!", RATE),
            ("status!", FLAG),
            ("order_id!", ID),
        ),
        key=("discount_id",),
        unique=(("code",),),
        references={"order_id": ("order", "order_id")},
        checks={"percentage_0_to_100": "percentage >= 0 and percentage <= 100"},
        lengths={"code": 30},
    ),
    TableSpec(
        "gift_card",
        _columns(
            ("gift_id!", ID),
            ("value!", MONEY),
            ("code!", TEXT),
            ("status!", FLAG),
            ("order_id!", ID),
        ),
        key=("gift_id",),
        unique=(("code",),),
        references={"order_id": ("order", "order_id")},
        lengths={"code": 30},
    ),
    TableSpec(
        "order_history_log",
        _columns(
            ("log_id!", ID),
            ("customer_id!", ID),
            ("order_id!", ID),
            ("order_details!", ORDER_DETAILS),
            ("logged_at!", TIME),
        ),
        key=("log_id",),
        references={
            "customer_id": ("customer", "customer_id"),
            "order_id": ("order", "order_id"),
        },
        defaults={"logged_at": "localtimestamp()"},
    ),
]

TABLES: dict[str, TableSpec] = {spec.name: spec for spec in _SPECS}
FOREIGN_KEYS: list[ForeignKey] = [fk for spec in _SPECS for fk in spec.foreign_keys]
