"""Rules that take the rows of a key strictly in order, as stateful processors.

Rows may arrive in any order within the watermark's delay. A row waits in the state until the watermark has passed
its time; then all waiting rows that are due are taken by (time, id). Rows that come after the watermark has passed their
time are taken as soon as they come, after those already taken, and marked as late; none is dropped. All state is in Spark's
state store. A call of the state store from Python costs far more than judging a row, so keys are dealt to buckets by their hash: a
bucket is what Spark groups by, and its state is a few entries that hold the numbers of all its keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Stands for a missing number: a column with missing numbers would come as floats.
NONE = -(1 << 62)

#: Buckets of keys of one stream. A checkpoint is only good for the number it was made with.
BUCKETS = 512


def number(name: str):
    return F.coalesce(F.col(name).cast("bigint"), F.lit(NONE)).alias(name)


def missing(name: str):
    """The opposite of ``number``."""
    return F.when(F.col(name) != NONE, F.col(name)).alias(name)


def _rows(values, width: int) -> np.ndarray:
    return np.array(values, dtype="int64").reshape(-1, width)


class Numbers:
    """Rows of whole numbers as one entry of a bucket's state; no entry without rows."""

    def __init__(self, handle, name: str, width: int):
        self.width = width
        self.state = handle.getValueState(name, "numbers binary")

    def get(self) -> np.ndarray:
        return _rows(np.frombuffer(self.state.get()[0], dtype="int64") if self.state.exists() else [], self.width)

    def put(self, rows: np.ndarray) -> None:
        if len(rows):
            self.state.update((np.ascontiguousarray(rows).tobytes(),))
        else:
            self.state.clear()

    def add(self, rows: np.ndarray, keys: int) -> None:
        """Add rows whose first ``keys`` numbers are not there yet; of several, the first."""
        held = self.get()
        every = pd.DataFrame(np.concatenate([held, rows]))
        every = every[~every.duplicated(list(range(keys)))].to_numpy()
        if len(every) > len(held):
            self.put(every)


class InOrder(StatefulProcessor):
    """Waiting rows (key, at_ms, id and ``row_columns``, all whole numbers), released in order. Subclasses note facts at once and settle
    what is due. A bucket has one timer for its earliest waiting row."""

    key: str
    row_columns: list[str]
    out: str

    def init(self, handle) -> None:
        self.handle = handle
        self.names = [self.key, "at_ms", "id", *self.row_columns]
        self.waiting = handle.getListState("waiting", "numbers binary")
        self.released: tuple | None = None

    def note(self, facts: pd.DataFrame) -> None:
        """Take facts, which have no order, such as a new product or order."""
        raise NotImplementedError

    def settle(self, due: np.ndarray, late: np.ndarray) -> pd.DataFrame:
        """Rows of ``out`` for ``due`` rows (key, at_ms, id, columns), which are in order within each key; ``late`` says which are."""
        raise NotImplementedError

    def tidy(self, passed: int) -> None:
        """Drop what is no longer needed once the watermark has passed ``passed``."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        asked, facts = [_rows([], len(self.names))], []
        for frame in rows:
            is_row = (frame["kind"] == "row").to_numpy()
            if not is_row.all():
                facts.append(frame[~is_row])
            asked.append(frame[self.names].to_numpy(dtype="int64")[is_row])
        if facts:
            self.note(pd.concat(facts))
        every = np.concatenate(asked)
        late = every[:, 1] <= passed
        self._wait(every[~late])
        if late.any():  # after those whose time has come as well
            yield from self._take(key, passed, every[late])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        if self.released != (key, passed):  # the first timer of a bucket releases all that is due
            yield from self._take(key, passed, _rows([], len(self.names)))

    def _wait(self, rows: np.ndarray) -> None:
        if len(rows):
            self.waiting.appendValue((np.ascontiguousarray(rows).tobytes(),))
            self.handle.registerTimer(int(rows[:, 1].min()))

    def _take(self, key: tuple, passed: int, late: np.ndarray) -> Iterator[pd.DataFrame]:
        """Settle what is due and then ``late`` rows, each in order; due rows wait no longer."""
        self.released = (key, passed)
        held = [_rows(np.frombuffer(row[0], dtype="int64"), len(self.names)) for row in self.waiting.get()] if self.waiting.exists() else []
        waiting = np.concatenate([late[:0], *held])
        is_due = waiting[:, 1] <= passed
        if is_due.any():
            self.waiting.clear()
            self._wait(waiting[~is_due])
        taken = np.concatenate([waiting[is_due], late])
        if len(taken):
            is_late = np.arange(len(taken)) >= is_due.sum()
            # By key, then those in time before late ones, then by time, id and the other columns.
            order = np.lexsort((*(taken[:, i] for i in range(taken.shape[1] - 1, 0, -1)), is_late, taken[:, 0]))
            yield self.settle(taken[order], is_late[order])
        self.tidy(passed)

    def close(self) -> None:
        pass


class StockGate(InOrder):
    """Accept or skip: a request is accepted if its quantity is still there."""

    key = "product_id"
    row_columns = ["quantity"]
    out = "product_id bigint, seq bigint, quantity bigint, accepted boolean, status string, stock_left bigint, late boolean"

    def init(self, handle) -> None:
        super().init(handle)
        self.left = Numbers(handle, "left", 2)

    def note(self, facts) -> None:
        opening = facts[facts["kind"] == "stock"]
        if len(opening):
            self.left.add(opening[["product_id", "quantity"]].to_numpy(dtype="int64"), 1)

    def settle(self, due, late) -> pd.DataFrame:
        left = dict(self.left.get().tolist())  # NONE is a product without a stock count
        statuses, stock_left = [], []
        for product, quantity in zip(due[:, 0].tolist(), due[:, 3].tolist()):
            have = left.get(product)
            if product == NONE or have is None or quantity == NONE:
                status = "NO_PRODUCT" if product == NONE else "NO_QUANTITY" if have is not None else "UNKNOWN_PRODUCT"
            elif have == NONE or quantity <= have:
                status = "DONE"
                have = left[product] = have if have == NONE else have - quantity
            else:
                status = "EXCEEDS_STOCK"
            statuses.append(status)
            stock_left.append(NONE if have is None else have)
        self.left.put(_rows(list(left.items()), 2))
        out = {"product_id": due[:, 0], "seq": due[:, 2], "quantity": due[:, 3], "accepted": [s == "DONE" for s in statuses]}
        return pd.DataFrame({**out, "status": statuses, "stock_left": stock_left, "late": late})


class Settlement(InOrder):
    """Payments with wallets, by the rule of ``operators.wallet``. A paid order leaves the state once nothing was paid for it
    during ``keep_ms``; orders that are not paid stay."""

    key = "account"
    row_columns = ["customer_id", "order_id", "cents"]
    out = (
        "payment_id bigint, at_ms bigint, customer_id bigint, order_id bigint, order_paid boolean, stored bigint, paid bigint, "
        "wallet bigint, status string, late boolean"
    )

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        super().init(handle)
        self.wallets = Numbers(handle, "wallets", 3)  # account, customer, cents
        self.orders = Numbers(handle, "orders", 6)  # account, order, total, paid, time of the last payment, is it paid

    def note(self, facts) -> None:
        wallets = facts[facts["kind"] == "wallet"]
        if len(wallets):
            self.wallets.add(wallets[["account", "customer_id", "cents"]].to_numpy(dtype="int64"), 2)
        orders = facts[facts["kind"] == "order"][["account", "order_id", "cents"]].to_numpy(dtype="int64")
        if len(orders):
            self.orders.add(np.column_stack([orders, np.broadcast_to([0, NONE, 0], (len(orders), 3))]), 2)

    def settle(self, due, late) -> pd.DataFrame:
        held, purses = self.orders.get(), self.wallets.get()
        # Only what these payments may change is taken apart.
        used, owned = np.isin(held[:, 1], due[:, 4]), np.isin(purses[:, 1], due[:, 3])
        orders = {(account, order): tuple(state) for account, order, *state in held[used].tolist()}
        wallets = {(account, customer): cents for account, customer, cents in purses[owned].tolist()}
        out = []
        for account, at, _, customer, order, cents in due.tolist():
            mine, purse = (account, order), (account, customer)
            if mine in orders and orders[mine][3] and orders[mine][2] + self.keep_ms < at:
                del orders[mine]  # it has left, or is about to
            if mine not in orders or purse not in wallets:
                out.append((False, cents, NONE, NONE, "UNKNOWN_CUSTOMER" if mine in orders else "UNKNOWN_ORDER"))
                continue
            total, before, _, done = orders[mine]
            wallet = wallets[purse]
            funds = before + cents + wallet
            enough = total != NONE and funds >= total
            if not enough:
                cents, wallet = funds, 0
            elif funds > total:
                wallet = funds - total
            orders[mine] = (total, before + cents, at, done or enough)
            wallets[purse] = wallet
            out.append((enough, cents, before + cents, wallet, "PAID" if enough else "OPEN"))
        self.orders.put(np.concatenate([held[~used], _rows([(*mine, *state) for mine, state in orders.items()], 6)]))
        self.wallets.put(np.concatenate([purses[~owned], _rows([(*purse, cents) for purse, cents in wallets.items()], 3)]))
        order_paid, stored, paid, wallet, status = zip(*out)
        asked = {"payment_id": due[:, 2], "at_ms": due[:, 1], "customer_id": due[:, 3], "order_id": due[:, 4]}
        told = {"order_paid": order_paid, "stored": stored, "paid": paid, "wallet": wallet, "status": status, "late": late}
        return pd.DataFrame({**asked, **told})

    def tidy(self, passed) -> None:
        held = self.orders.get()
        done, leaves = held[:, 5] == 1, held[:, 4] + self.keep_ms
        gone = done & (leaves <= passed)
        if gone.any():
            self.orders.put(held[~gone])
        if (done & ~gone).any():
            self.handle.registerTimer(int(leaves[done & ~gone].min()))


def in_order(events: DataFrame, time: str, delay: str, processor: InOrder, buckets: int = BUCKETS) -> DataFrame:
    """``events`` (the processor's key, kind, ``time``, id and the processor's columns) through a processor. The time goes on as a plain
    number, so that late rows reach the processor instead of being dropped; a row without a time counts as late."""
    timed = events.withWatermark(time, delay)
    at = F.coalesce(F.unix_millis(F.col(time)), F.lit(NONE)).alias("at_ms")
    bucket = F.pmod(F.xxhash64(processor.key), F.lit(buckets)).alias("bucket")
    numbers = [number(name) for name in (processor.key, "id", *processor.row_columns)]
    plain = timed.select(*numbers, "kind", at).select("*", bucket)
    return plain.groupBy("bucket").transformWithStateInPandas(processor, processor.out, "append", "eventTime")


class LateSplit(StatefulProcessor):
    """Marks rows whose day the watermark has passed; keeps no state."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            frame["late"] = frame["day_end_ms"] <= passed
            yield frame[[*self.columns, "late"]]

    def close(self) -> None:
        pass


# ---- two streams that wait for each other -------------------------------------------------------

#: Numbers of a packed row: its order, when it became known, first and last time of a partner, and what it tells (an order its date).
FACTS = ["order_id", "at", "first", "last", "told", "quantity", "sign"]

#: Kinds of packs. A tick has no rows; it lets a bucket see the watermark of every batch that has data.
ITEM, ORDER, TICK = range(3)

#: Rows that a task packs at a time, rows of a pack, and rows of a bucket that are compared and held as one entry.
PACKED, PACK, HELD = 1 << 17, 128, 1 << 17


def packed(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` (bucket, kind, ``FACTS``) with up to ``PACK`` rows of a bucket and kind as one binary value, column by column: a processor gets
    its rows one by one in Python, so they should be few."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() == 0:
            yield made(range(buckets), [TICK] * buckets, [b""] * buckets)
        some, n = [], 0
        for batch in batches:
            some.append(np.array([batch.column(name).to_numpy() for name in ("bucket", "kind", *FACTS)], dtype="int64"))
            n += batch.num_rows
            if n >= PACKED:
                yield by_bucket(np.concatenate(some, axis=1))
                some, n = [], 0
        if n:
            yield by_bucket(np.concatenate(some, axis=1))

    def by_bucket(rows: np.ndarray) -> pa.RecordBatch:
        rows = rows[:, np.lexsort((rows[1], rows[0]))]
        changes = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1
        groups = zip([0, *changes.tolist()], [*changes.tolist(), rows.shape[1]])
        cuts = [(a, min(a + PACK, end)) for begin, end in groups for a in range(begin, end, PACK)]
        first = [a for a, _ in cuts]
        return made(rows[0, first], rows[1, first], [rows[2:, a:b].tobytes() for a, b in cuts])

    def made(bucket, kind, numbers) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bucket, "int64"), pa.array(kind, "int64"), pa.array(numbers, "binary")], ["bucket", "kind", "numbers"])

    return rows.mapInArrow(pack, "bucket bigint, kind bigint, numbers binary")


def _facts(packs: list[bytes]) -> np.ndarray:
    """One row per name of ``FACTS``, one column per packed row."""
    none = np.empty((len(FACTS), 0), dtype="int64")
    return np.concatenate([none, *(np.frombuffer(x, dtype="int64").reshape(len(FACTS), -1) for x in packs)], axis=1)


def _by_order(rows: np.ndarray) -> np.ndarray:
    return rows[:, np.argsort(rows[0], kind="stable")]


def _squeezed(rows: np.ndarray) -> bytes:
    """``rows`` as bytes: of each name its least number, the bytes of a number, and how far each is above the least, in as few bytes as the
    largest needs. Times of partners are taken from when a row became known, which is mostly the same span."""
    rows = rows.copy()
    rows[2:4] -= rows[1]
    heads, columns = [rows.shape[1]], []
    for column in rows:
        low, high = int(column.min()), int(column.max())
        size = next((n for n in (0, 1, 2, 4) if high - low < 1 << 8 * n), 8)
        heads += [low if size < 8 else 0, size]
        columns.append((column - low if size < 8 else column).astype("i8" if size == 8 else f"u{size}").tobytes() if size else b"")
    return np.array(heads, dtype="int64").tobytes() + b"".join(columns)


def _unsqueezed(value: bytes) -> np.ndarray:
    n, *heads = np.frombuffer(value, dtype="int64", count=1 + 2 * len(FACTS)).tolist()
    rows, at = np.empty((len(FACTS), n), dtype="int64"), 8 * (1 + len(heads))
    for i, (low, size) in enumerate(zip(heads[::2], heads[1::2])):
        rows[i] = low
        if size:
            rows[i] += np.frombuffer(value, dtype="i8" if size == 8 else f"u{size}", count=n, offset=at)
        at += n * size
    rows[2:4] += rows[1]
    return rows


class Dated(StatefulProcessor):
    """Items with the dates of their orders, from packs of both. New rows are compared with what their bucket holds of the other kind and are then
    held until the watermark has passed the last time of a partner. A bucket holds rows in chunks, each a sorted entry of the state; a new
    chunk takes in the last ones unless they are much larger, so chunks are few and a row is written a few times only. Without ``leaves``
    rows are held for ever, and rows are late only behind the watermark of the last batch that had data."""

    out = "order_id bigint, product_id bigint, quantity bigint, sign bigint, date_us bigint"

    def __init__(self, most: int = HELD, leaves: bool = True):
        self.most, self.leaves = most, leaves

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "batch bigint, passed bigint")
        self.chunks = handle.getMapState("chunks", "chunk bigint", "numbers binary")
        self.index = Numbers(handle, "index", 4)  # kind, chunk, its rows, time after which none of them has a partner

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        late = self._late_ms(timerValues.getCurrentWatermarkInMs()) * 1000
        new, n = {ITEM: [], ORDER: [], TICK: []}, 0
        for frame in rows:
            for kind, numbers in zip(frame["kind"].tolist(), frame["numbers"].tolist()):
                new[kind].append(numbers)
                n += len(numbers) // (8 * len(FACTS))
                if n >= self.most:
                    yield from self._take(_facts(new[ITEM]), _facts(new[ORDER]), late)
                    new, n = {ITEM: [], ORDER: [], TICK: []}, 0
        if n:
            yield from self._take(_facts(new[ITEM]), _facts(new[ORDER]), late)

    def _late_ms(self, passed: int) -> int:
        """The watermark of the batch before, whose rows and older ones are late, as in Spark's own joins. A batch without data
        does not move the watermark, so after one it is that of this batch."""
        batch = int(TaskContext.get().getLocalProperty("streaming.sql.batchId"))
        before = self.seen.get() if self.seen.exists() else None
        self.seen.update((batch, passed))
        return before[1] if before and (before[0] == batch - 1 or not self.leaves) else passed

    def _take(self, items: np.ndarray, orders: np.ndarray, late: int) -> Iterator[pd.DataFrame]:
        items, orders = (_by_order(x[:, x[1] > late]) for x in (items, orders))
        index = self.index.get()
        if items.size:
            for chunk in index[index[:, 0] == ORDER, 1].tolist():
                yield from self._pairs(items, self._chunk(chunk))
        if orders.size:
            for chunk in index[index[:, 0] == ITEM, 1].tolist():
                yield from self._pairs(self._chunk(chunk), orders)
        yield from self._pairs(items, orders)
        for kind, some in ((ITEM, items), (ORDER, orders)):
            if some.size:
                index = self._hold(index, kind, some)
        self.index.put(index)

    def _chunk(self, chunk: int) -> np.ndarray:
        return _unsqueezed(self.chunks.getValue((chunk,))[0])

    def _hold(self, index: np.ndarray, kind: int, rows: np.ndarray) -> np.ndarray:
        number, taken = int(index[:, 1].max(initial=-1)) + 1, []
        for i in np.flatnonzero(index[:, 0] == kind)[::-1].tolist():
            _, chunk, size, _ = index[i].tolist()
            if size >= 2 * rows.shape[1] or size + rows.shape[1] > self.most:
                break
            rows = np.concatenate([self._chunk(chunk), rows], axis=1)
            self.chunks.removeKey((chunk,))
            taken.append(i)
        if taken:
            rows = _by_order(rows)
        self.chunks.updateValue((number,), (_squeezed(rows),))
        until = -(-int(rows[3].max()) // 1000)
        if self.leaves:
            self.handle.registerTimer(until)
        return np.concatenate([np.delete(index, taken, axis=0), _rows([kind, number, rows.shape[1], until], 4)])

    def _pairs(self, items: np.ndarray, orders: np.ndarray) -> Iterator[pd.DataFrame]:
        """Items with those orders of their number that became known in time; ``orders`` are sorted."""
        left = np.searchsorted(orders[0], items[0], "left")
        n = np.searchsorted(orders[0], items[0], "right") - left
        some = np.flatnonzero(n)
        left, n = left[some], n[some]
        ends, begin = np.cumsum(n), 0
        while begin < len(some):
            before = ends[begin] - n[begin]
            end = max(begin + 1, int(np.searchsorted(ends, before + self.most, "right")))
            part = slice(begin, end)
            i = np.repeat(some[part], n[part])
            j = np.arange(len(i)) + np.repeat(left[part] - (ends[part] - n[part] - before), n[part])
            near = (items[2, i] <= orders[1, j]) & (orders[1, j] <= items[3, i])
            i, j = i[near], j[near]
            if len(i):
                yield pd.DataFrame({"order_id": items[0, i], "product_id": items[4, i], "quantity": items[5, i], "sign": items[6, i], "date_us": orders[4, j]})
            begin = end

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        index = self.index.get()
        gone = index[:, 3] <= timerValues.getCurrentWatermarkInMs()
        if gone.any():
            for chunk in index[gone, 1].tolist():
                self.chunks.removeKey((chunk,))
            self.index.put(index[~gone])
        return iter(())

    def close(self) -> None:
        pass


def dated(items: DataFrame, orders: DataFrame, buckets: int, processor: Dated) -> DataFrame:
    """Rows of ``Dated.out`` from two streams with the columns ``FACTS``."""
    bucket = F.pmod(F.xxhash64("order_id"), F.lit(buckets)).alias("bucket")
    both = [rows.select(bucket, F.lit(kind).cast("bigint").alias("kind"), *FACTS) for kind, rows in ((ITEM, items), (ORDER, orders))]
    return packed(both[0].unionByName(both[1]), buckets).groupBy("bucket").transformWithStateInPandas(processor, processor.out, "append", "eventTime")
