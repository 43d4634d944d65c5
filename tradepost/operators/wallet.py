"""Payments with the payer's wallet, taken strictly in order of date and id.

For a payment of order o by customer c, take the stored amounts of o up to and including it and add
the wallet of c: if that reaches the order's total, o is paid and an excess above zero becomes the
new wallet (an exact match leaves the wallet as it was); if not, the payment's stored amount becomes the
whole sum and the wallet is emptied. Earlier payments therefore count again after an insufficient one,
and paying a paid order fills the wallet: both are the shop's rule.

A wallet belongs to the payer, whoever placed the order. Payers who paid for a common order depend on
each other, directly or over others, and are folded as one group; all other payers are a group each.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.durable import cut
from ..functions.fold import CHUNK, State, fold_in_order
from ..functions.groups import linked_groups
from ..functions.joins import keyed_join
from ..sources.schema import MONEY, MONEY_SUM

Frames = Mapping[str, DataFrame]

_WRITES = T.StructType(
    [
        T.StructField("_enough", T.BooleanType()),
        T.StructField("_stored", T.LongType()),
        T.StructField("_paid_after", T.LongType()),
        T.StructField("_wallet_after", T.LongType()),
    ]
)
_READS = ("_group", CHUNK, "customer_id", "order_id", "_amount", "_total", "_paid_before", "_wallet_before")


class _Ledger:
    """The rule above for rows sorted by group, chunk, date and payment; money in cents."""

    def __init__(self):
        self.run = None
        self.wallets: dict[int, int] = {}
        self.paid: dict[int, int] = {}

    def __call__(self, columns):
        out = {"_enough": [], "_stored": [], "_paid_after": [], "_wallet_after": []}
        for group, chunk, customer, order, amount, total, paid, wallet in zip(*(columns[c] for c in _READS)):
            if (group, chunk) != self.run:
                self.run, self.wallets, self.paid = (group, chunk), {}, {}
            before = self.paid.get(order, paid)
            wallet = self.wallets.get(customer, wallet)
            funds = before + amount + wallet
            enough = total is not None and funds >= total
            if enough:
                if funds > total:
                    wallet = funds - total
            else:
                amount, wallet = funds, 0
            self.paid[order] = before + amount
            self.wallets[customer] = wallet
            out["_enough"].append(enough)
            out["_stored"].append(amount)
            out["_paid_after"].append(before + amount)
            out["_wallet_after"].append(wallet)
        return out


def _cents(money: str):
    return (F.col(money) * 100).cast("bigint")


def _money(cents: str, kind):
    return (F.col(cents).cast("decimal(20,0)") / 100).cast(kind)


def payer_groups(payment: DataFrame) -> DataFrame | None:
    """(customer_id, _group) of payers who share an order with another, None if nobody does."""
    payers = payment.groupBy("order_id").agg(F.min("customer_id").alias("a"), F.max("customer_id").alias("_b"))
    shared = payers.filter(F.col("a") != F.col("_b")).select("order_id", "a")
    if shared.isEmpty():
        return None
    shared = cut(shared)
    links = (
        keyed_join(payment.select("order_id", F.col("customer_id").alias("b")), shared, "order_id")
        .filter(F.col("a") != F.col("b"))
        .select("a", "b")
        .distinct()
    )
    return linked_groups(links).select(F.col("node").alias("customer_id"), F.col("group").alias("_group"))


def payments_with_status(tables: Frames) -> DataFrame:
    """``wallet_ledger`` plus ``status``, with a row for every payment: PAID if the order is paid by it, OPEN if not, and UNKNOWN_ORDER or
    UNKNOWN_CUSTOMER for one whose order or payer is not there, which settles nothing."""
    payment = tables["payment"]
    known_order = tables["order"].select("order_id", F.lit(True).alias("_order"))
    known_payer = tables["customer"].select("customer_id", F.lit(True).alias("_payer"))
    marked = keyed_join(keyed_join(payment, known_order, "order_id", "left"), known_payer, "customer_id", "left")
    status = F.when(F.col("_order").isNull(), "UNKNOWN_ORDER").when(F.col("_payer").isNull(), "UNKNOWN_CUSTOMER")
    marked = cut(marked.withColumn("status", status).select(*payment.columns, "status"))
    settled = wallet_ledger({**tables, "payment": marked.filter("status is null").drop("status")})
    settled = settled.withColumn("status", F.when(F.col("order_paid"), "PAID").otherwise("OPEN"))
    told = {
        "order_paid": F.lit(False),
        "stored_amount": F.col("amount").cast(settled.schema["stored_amount"].dataType),
        "paid_sum": F.lit(None).cast(settled.schema["paid_sum"].dataType),
        "wallet_after": F.lit(None).cast(settled.schema["wallet_after"].dataType),
    }
    refused = marked.filter("status is not null").withColumns(told)
    return settled.unionByName(refused.select(settled.columns))


def wallet_ledger(tables: Frames, paid_before: DataFrame | None = None) -> DataFrame:
    """One row per payment: stored amount, whether the order is paid by it, the order's paid sum and the
    payer's wallet afterwards. ``paid_before`` (order_id, paid) carries on from an earlier batch."""
    orders = tables["order"].select("order_id", "total_price")
    known = keyed_join(tables["payment"], orders, "order_id")
    wallets = tables["customer"].select("customer_id", F.coalesce("wallet_balance", F.lit(0)).alias("wallet_balance"))
    groups = payer_groups(tables["payment"])
    if groups is None:
        wallets = wallets.withColumn("_group", F.col("customer_id"))
    else:
        wallets = wallets.join(groups, "customer_id", "left").withColumn("_group", F.coalesce("_group", "customer_id"))
    rows = keyed_join(known, wallets, "customer_id")
    if paid_before is not None:
        rows = keyed_join(rows, paid_before.select("order_id", "paid"), "order_id", "left")
    else:
        rows = rows.withColumn("paid", F.lit(0).cast(MONEY_SUM))
    rows = rows.withColumn("paid", F.coalesce("paid", F.lit(0))).select(
        "payment_id",
        "payment_date",
        "customer_id",
        "order_id",
        "_group",
        _cents("amount").alias("_amount"),
        _cents("total_price").alias("_total"),
        _cents("paid").alias("_paid_before"),
        _cents("wallet_balance").alias("_wallet_before"),
    )
    folded = fold_in_order(
        rows,
        "_group",
        ("payment_date", "payment_id"),
        [
            State(("customer_id",), "_wallet_before", "_wallet_after"),
            State(("order_id",), "_paid_before", "_paid_after"),
        ],
        _READS,
        _WRITES,
        _Ledger,
        sizes=tables["payment"].groupBy(F.col("customer_id").alias("_group")).count() if groups is None else None,
    )
    return folded.select(
        "payment_id",
        "payment_date",
        "customer_id",
        "order_id",
        F.col("_enough").alias("order_paid"),
        _money("_stored", MONEY_SUM).alias("stored_amount"),
        _money("_paid_after", MONEY_SUM).alias("paid_sum"),
        _money("_wallet_after", MONEY_SUM).alias("wallet_after"),
    )


def settle_with_wallet(tables: Frames, ledger: DataFrame) -> dict[str, DataFrame]:
    """The order, customer and payment tables after the ledger."""
    paid = ledger.filter("order_paid").select("order_id").distinct().withColumn("_paid", F.lit(True))
    latest = ledger.groupBy("customer_id").agg(
        F.max_by("wallet_after", F.struct("payment_date", "payment_id")).alias("_wallet")
    )
    stored = ledger.select("payment_id", F.col("stored_amount").alias("_stored"))
    return {
        "order": tables["order"]
        .join(paid, "order_id", "left")
        .withColumn("status", F.col("status") | F.coalesce("_paid", F.lit(False)))
        .drop("_paid"),
        "customer": tables["customer"]
        .join(latest, "customer_id", "left")
        .withColumn("wallet_balance", F.coalesce("_wallet", "wallet_balance").cast(MONEY))
        .drop("_wallet"),
        "payment": tables["payment"]
        .join(stored, "payment_id", "left")
        .withColumn("amount", F.coalesce("_stored", "amount").cast(MONEY))
        .drop("_stored"),
    }
