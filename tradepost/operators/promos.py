"""Batches of discount codes and gift cards applied to orders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.durable import cut
from ..functions.fold import CHUNK, State, fold_in_order
from ..functions.joins import first_per_key, keyed_join
from ..functions.limits import LIMITS
from ..sources.schema import MONEY


@dataclass
class PromoResult:
    orders: DataFrame
    codes: DataFrame
    log: DataFrame


def _judge(requests: DataFrame, codes: DataFrame, id_column: str, worth: str) -> DataFrame:
    """Requests (seq, order_id, code) with a status. The code must exist for that order and be usable;
    of several requests for one code the earliest wins and the rest find it used."""
    known = codes.select("code", F.col("order_id").alias("_owner"), F.col("status").alias("_usable"), id_column, worth)
    matched = keyed_join(requests.select("seq", "order_id", "code"), known, "code", "left")
    found = F.coalesce(F.col("_owner") == F.col("order_id"), F.lit(False))
    usable = matched.filter(found & F.col("_usable"))
    winners = first_per_key(usable, "code").filter("is_first").select("code", "seq", F.lit(True).alias("_wins"))
    return (
        matched.join(winners, ["code", "seq"], "left")
        .withColumn(
            "status",
            F.when(~found, "NOT_AVAILABLE").when(F.col("_wins"), "APPLIED").otherwise("INACTIVE"),
        )
        .drop("_owner", "_usable", "_wins")
    )


def _used(codes: DataFrame, applied: DataFrame) -> DataFrame:
    spent = applied.select("code", F.lit(True).alias("_spent"))
    return (
        codes.join(spent, "code", "left")
        .withColumn("status", F.col("status") & F.col("_spent").isNull())
        .drop("_spent")
        .select(*codes.columns)
    )


_WRITES = T.StructType([T.StructField("_after", T.LongType())])
_READS = ("order_id", CHUNK, "_percent", "_before")


class _Compound:
    """Total in cents after each percentage in turn (in hundredths of a percent), halves rounded away
    from zero each time."""

    def __init__(self):
        self.run = None
        self.total = 0

    def __call__(self, columns):
        after = []
        for order, chunk, percent, before in zip(*(columns[c] for c in _READS)):
            if (order, chunk) != self.run:
                self.run, self.total = (order, chunk), before
            if self.total is not None:
                size = (abs(self.total) * (10000 - percent) * 2 + 10000) // 20000
                self.total = size if self.total >= 0 else -size
            after.append(self.total)
        return {"_after": after}


def apply_discounts(order: DataFrame, discount_code: DataFrame, requests: DataFrame) -> PromoResult:
    """Reduce order totals by the codes' percentages and use the codes up. Several codes of one order
    compound in arrival order, rounded to cents after each."""
    judged = _judge(requests, discount_code, "discount_id", "percentage")
    applied = judged.filter("status = 'APPLIED'").select("seq", "order_id", "code", "percentage")
    # Several codes: the order matters because of the rounding. The codes of an order go into one array, unless they are too
    # many for that.
    sizes = cut(applied.groupBy("order_id").agg(F.count(F.lit(1)).alias("_codes")))
    few = F.col("_codes") <= LIMITS.fold_rows
    totals = order.select("order_id", "total_price")
    listed = (
        keyed_join(applied, sizes.filter(few), "order_id", "left_semi")
        .groupBy("order_id")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "percentage"))).alias("_steps"))
    )
    after = _reduced(keyed_join(listed, totals, "order_id"))
    long = sizes.filter(~few)
    if not long.isEmpty():
        after = after.unionByName(_folded(keyed_join(applied, long, "order_id", "left_semi"), totals, long))
    orders = (
        order.join(after.withColumn("_hit", F.lit(True)), "order_id", "left")
        .withColumn("total_price", F.when(F.col("_hit"), F.col("_after")).otherwise(F.col("total_price")))
        .select(*order.columns)
    )
    return PromoResult(orders, _used(discount_code, applied), judged.select("seq", "order_id", "code", "status"))


def _reduced(rows: DataFrame) -> DataFrame:
    """(order_id, _after): total_price after each percentage in turn, halves rounded away from zero each time."""
    start = F.col("total_price").cast(MONEY)
    step = lambda total, x: (total * (1 - x["percentage"] / 100)).cast(MONEY)
    return rows.select("order_id", F.aggregate("_steps", start, step).alias("_after"))


def _folded(applied: DataFrame, totals: DataFrame, sizes: DataFrame) -> DataFrame:
    """The same for orders with very many codes."""
    steps = keyed_join(applied, totals, "order_id").select(
        "seq",
        "order_id",
        (F.col("percentage") * 100).cast("bigint").alias("_percent"),
        (F.col("total_price") * 100).cast("bigint").alias("_before"),
    )
    folded = fold_in_order(
        steps,
        "order_id",
        ("seq",),
        [State(("order_id",), "_before", "_after")],
        _READS,
        _WRITES,
        _Compound,
        sizes=sizes.select("order_id", F.col("_codes").alias("count")),
    )
    last = folded.groupBy("order_id").agg(F.max_by("_after", "seq").alias("_cents"))
    return last.select("order_id", (F.col("_cents").cast("decimal(20,0)") / 100).cast(MONEY).alias("_after"))


def apply_gift_cards(order: DataFrame, gift_card: DataFrame, requests: DataFrame) -> PromoResult:
    """Reduce order totals by the cards' values and use the cards up. A total may fall below zero."""
    judged = _judge(requests, gift_card, "gift_id", "value")
    applied = judged.filter("status = 'APPLIED'")
    worth = applied.groupBy("order_id").agg(F.sum("value").alias("_worth"))
    orders = (
        order.join(worth, "order_id", "left")
        .withColumn("total_price", (F.col("total_price") - F.coalesce("_worth", F.lit(0))).cast(MONEY))
        .select(*order.columns)
    )
    return PromoResult(orders, _used(gift_card, applied), judged.select("seq", "order_id", "code", "status"))
