"""Stock-limited requests: taken in arrival order, a request is accepted if its quantity is still there
and is skipped otherwise, and the next one is tried."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.durable import cut
from ..functions.fold import CHUNK, State, fold, fold_in_order
from ..functions.joins import keyed_join
from ..functions.limits import LIMITS
from ..functions.scan import running_total

ROUNDS = 6
_WRITES = T.StructType([T.StructField("accepted", T.BooleanType()), T.StructField("_left", T.LongType())])
_READS = ("product_id", CHUNK, "quantity", "_stock")


class _Greedy:
    """Accept-or-skip for rows sorted by product, chunk and arrival."""

    def __init__(self):
        self.run = None
        self.left = 0

    def __call__(self, columns):
        run, left = self.run, self.left
        taken, remaining = [], []
        for product, chunk, quantity, stock in zip(*(columns[c] for c in _READS)):
            if (product, chunk) != run:
                run, left = (product, chunk), stock
            ok = quantity <= left
            if ok:
                left -= quantity
            taken.append(ok)
            remaining.append(left)
        self.run, self.left = run, left
        return {"accepted": taken, "_left": remaining}


def _positive(quantity: str = "quantity"):
    return F.greatest(F.col(quantity), F.lit(0)).cast("bigint")


def allocate_stock(requests: DataFrame, stock: DataFrame) -> DataFrame:
    """``requests`` (with product_id, seq, quantity) plus ``accepted`` and ``status``. ``stock`` has product_id and
    stock_count; a product without a stock count accepts everything. ``seq`` is a whole arrival number,
    unique within a product.

    Every request is kept: one for no product, an unknown product or no quantity is not accepted, takes no stock and says so
    in its status. Products whose stock covers all requests need only a sum. Of the others, very long queues are first
    decided in bulk as far as that goes, and what is left is walked through in order, long queues in chunks side by side.
    """
    on_hand = stock.select("product_id", F.col("stock_count").cast("bigint").alias("_stock"), F.lit(True).alias("_product"))
    judged = keyed_join(requests, on_hand, "product_id", "left").withColumn(
        "status",
        F.when(F.col("product_id").isNull(), "NO_PRODUCT")
        .when(F.col("_product").isNull(), "UNKNOWN_PRODUCT")
        .when(F.col("quantity").isNull(), "NO_QUANTITY"),
    )
    judged = cut(judged.select(*requests.columns, "_stock", "status"))
    refused = judged.filter("status is not null").withColumn("accepted", F.lit(False))
    decided = _decide(judged.filter("status is null").drop("status")).withColumn(
        "status", F.when(F.col("accepted"), "DONE").otherwise("EXCEEDS_STOCK")
    )
    columns = [*requests.columns, "accepted", "status"]
    return decided.select(*columns).unionByName(refused.select(*columns))


def _decide(rows: DataFrame) -> DataFrame:
    """``rows`` with a quantity and the stock of their product plus ``accepted``."""
    sums = rows.groupBy("product_id").agg(
        F.max("_stock").alias("_on_hand"),
        F.sum(_positive()).alias("_wanted"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("quantity") < 0).alias("_returns"),
    )
    scarce_sum = F.coalesce(F.col("_wanted") > F.col("_on_hand"), F.lit(False))
    size = sums.agg(
        F.coalesce(F.sum(F.when(~scarce_sum, F.col("_n"))), F.lit(0)).alias("easy"),
        F.coalesce(F.sum(F.when(scarce_sum, F.col("_n"))), F.lit(0)).alias("scarce"),
        F.coalesce(F.max(F.when(scarce_sum, F.col("_n"))), F.lit(0)).alias("most"),
    ).first()
    if not size["scarce"]:
        return rows.withColumn("accepted", F.lit(True))
    # Only products that run short go on; products without a stock count never do.
    short = cut(sums.filter(scarce_sum).select("product_id", "_n", "_returns"))
    scarce = keyed_join(rows, short, "product_id")
    easy = rows.join(short.select("product_id"), "product_id", "left_anti").withColumn("accepted", F.lit(True))
    if size["most"] <= LIMITS.fold_rows:
        return easy.unionByName(_walk(scarce.drop("_n", "_returns"), size["scarce"]))
    # A return can make room again, so only queues without one can be decided in bulk.
    bulk = (F.col("_n") > LIMITS.fold_rows) & (F.col("_returns") == 0)
    decided, rest = _shorten(cut(scarce.filter(bulk).drop("_n", "_returns")))
    undecided = scarce.filter(~bulk).drop("_n", "_returns").unionByName(rest)
    return easy.unionByName(decided).unionByName(_walk_long(cut(undecided)))


def _walk_long(rows: DataFrame) -> DataFrame:
    """``rows`` plus ``accepted`` for queues of any length. A long queue whose stock stays within few values is walked chunk by chunk,
    see ``_by_tables``; of one with large returns, chunks start from guesses."""
    stock = F.max("_stock")
    most = F.greatest(stock, F.lit(0)) + F.sum(F.greatest(-F.col("quantity").cast("bigint"), F.lit(0)))
    queues = cut(
        rows.groupBy("product_id").agg(
            F.count(F.lit(1)).alias("_n"), F.least(stock, F.lit(0)).alias("_low"), most.alias("_most"), stock.alias("_opening")
        )
    )
    long = F.col("_n") > LIMITS.fold_rows
    narrow = F.col("_most") - F.col("_low") < LIMITS.stock_values
    tabled = queues.filter(long & narrow)
    if tabled.isEmpty():
        return _guessed(rows)
    return _guessed(rows.join(tabled, "product_id", "left_anti")).unionByName(_by_tables(keyed_join(rows, tabled, "product_id"), rows.columns))


def _guessed(rows: DataFrame) -> DataFrame:
    state = [State(("product_id",), "_stock", "_left")]
    return fold_in_order(rows, "product_id", ("seq",), state, _READS, _WRITES, _Greedy).drop("_left")


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk of a queue, whose rows come in order: the stock after it for every stock from ``_low`` to ``_most`` before it."""
    chunk, left = None, np.empty(0, np.int64)

    def table() -> pa.RecordBatch:
        arrays = [pa.array([chunk[0]], pa.int64()), pa.array([chunk[1]], pa.int32()), pa.array([left.tolist()], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, names=["product_id", CHUNK, "_after"])

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("product_id", CHUNK, "quantity", "_low", "_most"))
        for product, number, quantity, low, most in zip(*columns):
            if (product, number) != chunk:
                if chunk:
                    yield table()
                chunk, left = (product, number), np.arange(low, most + 1)
            np.subtract(left, quantity, out=left, where=left >= quantity)
    if chunk:
        yield table()


def _by_tables(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` (with ``_n``, ``_low``, ``_most`` and ``_opening`` of their queue) plus ``accepted``.

    Queues are cut into chunks of consecutive requests. What a chunk makes of any stock it may find is a table of few values, made for all
    chunks side by side. The tables of a queue, one row per chunk, are read one after another from the opening stock on, which
    gives the stock each chunk really finds; then all chunks are walked side by side. No queue is ever in one task.
    """
    n = rows.count()
    chunks = -(-2 * n // LIMITS.fold_rows)
    # The bounds come from a sample: write the split out so that every later use sees the same one.
    dealt = cut(rows.repartitionByRange(chunks, "product_id", "seq").withColumn(CHUNK, F.spark_partition_id()))
    ordered = dealt.repartition(chunks, CHUNK).sortWithinPartitions(CHUNK, "product_id", "seq")
    tables = ordered.select("product_id", CHUNK, F.col("quantity").cast("bigint").alias("quantity"), "_low", "_most").mapInArrow(
        _tables, f"product_id bigint, {CHUNK} int, _after array<bigint>"
    )
    opening = dealt.select("product_id", "_low", "_opening").distinct()
    queue = F.array_sort(F.collect_list(F.struct(CHUNK, "_after"))).alias("_queue")
    lined = tables.groupBy("product_id").agg(queue).join(opening, "product_id")
    none = F.array().cast(f"array<struct<{CHUNK}: int, _stock: bigint>>")

    def next_chunk(seen, chunk):
        found = F.struct(chunk[CHUNK].alias(CHUNK), seen["now"].alias("_stock"))
        after = F.element_at(chunk["_after"], (seen["now"] - F.col("_low") + 1).cast("int"))
        return F.struct(after.alias("now"), F.concat(seen["starts"], F.array(found)).alias("starts"))

    seen = F.aggregate("_queue", F.struct(F.col("_opening").alias("now"), none.alias("starts")), next_chunk)
    starts = cut(lined.select("product_id", F.explode(seen["starts"]).alias("s")).select("product_id", "s.*"))
    found = dealt.drop("_stock").join(starts, ["product_id", CHUNK])
    return fold(found.select(*columns, CHUNK), "product_id", ("seq",), _READS, _WRITES, _Greedy, n).drop(CHUNK, "_left")


def _walk(rows: DataFrame, n: int) -> DataFrame:
    """All ``n`` rows in order, for queues that one task can take."""
    return fold(rows, "product_id", ("seq",), _READS, _WRITES, _Greedy, n).drop(CHUNK, "_left")


def _shorten(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decide rows in bulk, in a few rounds or until no product has more than ``LIMITS.fold_rows``
    undecided ones.

    In each round a running total finds the first request that does not fit. All before it are
    accepted, it is skipped, and so is every later request for more than is left then. What is left is
    now less than that one request asked for, so queues shrink quickly. Returns the decided rows
    and the open ones with their stock.
    """
    columns = rows.columns
    decided = None
    for _ in range(ROUNDS):
        quantity = F.col("quantity").cast("bigint")
        totals = running_total(rows, ["product_id"], "seq", quantity, "_taken")
        blocked = (
            totals.filter(F.col("_taken") > F.col("_stock")).groupBy("product_id").agg(F.min("seq").alias("_blocker"))
        )
        marked = cut(keyed_join(totals, blocked, "product_id", "left"))
        before = F.col("_blocker").isNull() | (F.col("seq") < F.col("_blocker"))
        left = marked.groupBy("product_id").agg(
            (F.max("_stock") - F.coalesce(F.sum(F.when(before, quantity)), F.lit(0))).alias("_left")
        )
        skipped = (F.col("seq") == F.col("_blocker")) | (F.col("quantity") > F.col("_left"))
        judged = cut(
            keyed_join(marked, left, "product_id").withColumn("accepted", F.when(before, True).when(skipped, False))
        )
        sure = judged.filter("accepted is not null").select(*columns, "accepted")
        decided = sure if decided is None else decided.unionByName(sure)
        rows = judged.filter("accepted is null").withColumn("_stock", F.col("_left")).select(*columns)
        if rows.groupBy("product_id").count().filter(F.col("count") > LIMITS.fold_rows).isEmpty():
            break
    return decided, rows


def remaining_stock(allocated: DataFrame, product: DataFrame) -> DataFrame:
    """``product`` with the accepted quantities taken off its stock."""
    taken = allocated.filter("accepted").groupBy("product_id").agg(F.sum("quantity").alias("_taken"))
    return (
        product.join(taken, "product_id", "left")
        .withColumn("stock_count", (F.col("stock_count") - F.coalesce("_taken", F.lit(0))).cast("int"))
        .drop("_taken")
    )
