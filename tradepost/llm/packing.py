"""Documents packed into as few fixed-length sequences as possible.

Lengths of pieces are counted, and a plan for the counts is made from a linear program over configurations, ways to fill
one sequence: every length has a price, a knapsack finds the configuration of the highest price, it is used as far as the
rarest of its lengths allows a step, and the prices of the lengths it covers fall. Whole uses are taken over, the pieces left
are placed best-fit. The plan depends only on counts per length, so its size is bounded however many pieces there are. Then every
piece takes the place that the plan has for its length and number.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunks import ID, document_encoder
from .scratch import ROW, Scratch, column, numbered

Plan = list[tuple[tuple[int, ...], int]]


def knapsack(prices: np.ndarray, capacity: int) -> tuple[int, ...]:
    """Lengths (with repeats) of the highest total price that fit; ``prices`` by length, 0 for lengths not on offer. Of equal
    prices the longest length is taken."""
    lengths = np.flatnonzero(prices > 0)[::-1]
    worth = prices[lengths]
    skip = np.searchsorted(-lengths, -np.arange(capacity + 1)).tolist()  # lengths that are too long
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if skip[c] < len(lengths):
            values = best[c - lengths[skip[c] :]] + worth[skip[c] :]
            k = values.argmax()
            if values[k] > best[c]:
                best[c], last[c] = values[k], lengths[skip[c] + k]
    taken, c = [], capacity
    while c > 0:
        if last[c]:
            taken.append(int(last[c]))
        c -= last[c] or 1
    return tuple(sorted(taken, reverse=True))


def fractional(counts: np.ndarray, capacity: int, step: float = 0.25, rate: float = 3.0, rounds: int = 2000) -> dict[tuple[int, ...], float]:
    """Uses per configuration by multiplicative weights. A length's price is its length times exp(-rate x the share of it that is
    covered). Never covers more than there is; what ``rounds`` leave over is placed best-fit."""
    lengths = np.arange(len(counts))
    left, shut = counts.astype(float), np.zeros(len(counts), bool)
    uses: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        open_ = (left >= 1) & ~shut
        if not open_.any():
            break
        covered = 1 - np.divide(left, counts, out=np.ones(len(counts)), where=counts > 0)
        config = knapsack(np.where(open_, lengths * np.exp(-rate * covered), 0.0), capacity)
        need = np.bincount(config, minlength=len(counts))
        used = need > 0
        room = (left[used] / need[used]).min()
        if room < 1:  # wants a length more often than it is left
            shut |= need > left
            continue
        amount = min(room, max(1.0, step * (counts[used] / need[used]).min()))
        uses[config] = uses.get(config, 0.0) + amount
        left -= amount * need
    return uses


def make_plan(counts: np.ndarray, capacity: int) -> Plan:
    """Configurations and how many sequences use them; every piece of ``counts`` (by length) exactly once.

    The fractional uses are scaled by a few shares and rounded down, each time the pieces left are placed best-fit, and the
    plan with the fewest sequences is taken.
    """
    counts = counts.astype(np.int64)
    whole: Plan = [((capacity,), int(counts[capacity]))] if counts[capacity] else []
    rest = counts.copy()
    rest[capacity] = 0
    uses = fractional(rest, capacity)
    best: Plan | None = None
    for share in (1.0, 0.75, 0.5, 0.25, 0.1, 0.0):
        for least in (capacity, 0):  # full configurations only, or all
            taken = [(c, int(use * share)) for c, use in uses.items() if sum(c) >= least and int(use * share)]
            left = rest.copy()
            for config, times in taken:
                left -= times * np.bincount(config, minlength=len(left))
            plan = taken + _best_fit(left, capacity)
            if best is None or sum(t for _, t in plan) < sum(t for _, t in best):
                best = plan
    return whole + best


def _best_fit(left: np.ndarray, capacity: int) -> Plan:
    """Best fit by falling length over counts: equal sequences are one entry however many they are."""
    rooms: dict[int, list[list]] = {}  # room -> [configuration, number of sequences]
    order: list[int] = []

    def add(room: int, config: tuple[int, ...], times: int) -> None:
        if room not in rooms:
            rooms[room] = []
            bisect.insort(order, room)
        rooms[room].append([config, times])

    for length in range(len(left) - 1, 0, -1):
        todo = int(left[length])
        while todo:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                full, rest = divmod(todo, each)
                if full:
                    add(capacity - each * length, (length,) * each, full)
                if rest:
                    add(capacity - rest * length, (length,) * rest, 1)
                break
            room = order[at]
            entry = rooms[room][-1]
            each = min(room // length, todo)
            times = min(todo // each, entry[1])
            entry[1] -= times
            if not entry[1]:
                rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[at]
            add(room - each * length, entry[0] + (length,) * each, times)
            todo -= each * times
    return [(config, times) for room in order for config, times in rooms[room]]


def plan_rows(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, end number, copies, first sequence, offset of the first copy): pieces of a length are numbered from 0,
    and those of one row take ``copies`` places side by side in consecutive sequences."""
    out, sequence, seen = [], 0, {}
    for config, times in plan:
        offset = 0
        for length in dict.fromkeys(config):
            copies = config.count(length)
            first = seen.get(length, 0)
            seen[length] = first + copies * times
            out.append((length, first, seen[length], copies, sequence, offset))
            offset += copies * length
        sequence += times
    return out


def _cut_up(path: str, end_id: int, capacity: int):
    schema = pa.schema(
        [("row", pa.int64()), ("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]
        + [("ids", pa.binary()), ("part", pa.int32()), ("nth", pa.int64())]
    )
    end = np.array([end_id], ID).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = document_encoder(path), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows = []
                encoded = encode([t or "" for t in batch.column("text").to_pylist()])
                for row, doc, ids in zip(batch.column("row").to_pylist(), batch.column("id").to_pylist(), encoded):
                    ids += end
                    n = len(ids) // 4
                    # Only the first piece may be shorter.
                    starts = [0, *range(n % capacity or capacity, n, capacity)]
                    for piece, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                        rows.append((row, doc, piece, a, b - a, ids[4 * a : 4 * b], part, seen[b - a]))
                        seen[b - a] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def pieces(
    docs: DataFrame, path: str, end_id: int = 2, capacity: int = 1024, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces (row, id, piece, start, length, ids, part, nth) of all ``docs``: the ids of a text and ``end_id``, cut into pieces of
    ``capacity`` ids of which only the first may be shorter. ``ids`` are little-endian unsigned 32-bit integers, ``nth``
    numbers the pieces of a length inside a part."""
    rows = numbered(docs).select(
        F.col(ROW).alias("row"), column(docs, id_column).cast("bigint").alias("id"), column(docs, text).alias("text")
    )
    schema = "row bigint, id bigint, piece int, start bigint, length bigint, ids binary, part int, nth bigint"
    return rows.mapInArrow(_cut_up(path, end_id, capacity), schema)


def place(cut: DataFrame, capacity: int, keep: Scratch, extra: tuple[str, ...] = ()) -> DataFrame:
    """(row, id, piece, start, length, sequence_id, offset, and ``extra``) for stored ``pieces``."""
    spark = cut.sparkSession
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = keep.cut(counts)
    by_length = np.zeros(capacity + 1, np.int64)  # one number per length comes to the driver
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():
        by_length[length] = n
    plan = spark.createDataFrame(
        plan_rows(make_plan(by_length, capacity)) or [(0, 0, 0, 1, 0, 0)],
        "p_length bigint, p_first bigint, p_end bigint, copies bigint, sequence bigint, p_offset bigint",
    )
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    number = cut.select("row", "id", "piece", "start", "length", "part", "nth", *extra).join(before, ["part", "length"])
    number = number.withColumn("number", F.col("before") + F.col("nth"))
    # A few rows per length and configuration: bounded by the capacity and the rounds of the plan.
    fits = (F.col("length") == F.col("p_length")) & (F.col("number") >= F.col("p_first")) & (F.col("number") < F.col("p_end"))
    inside = F.col("number") - F.col("p_first")
    return number.join(F.broadcast(plan), fits).select(
        "row",
        "id",
        "piece",
        "start",
        "length",
        *extra,
        (F.col("sequence") + F.expr("(number - p_first) div copies")).alias("sequence_id"),
        (F.col("p_offset") + (inside % F.col("copies")) * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, path: str, capacity: int = 1024, **settings) -> DataFrame:
    """One row per piece of ``docs``: row, id, piece, start, length, sequence_id, offset and ids_crc32 (of the packed ids).

    Missing and empty texts are one piece that holds the end id. Repeated rows are packed each for itself. An empty table gives
    no rows. Columns other than id and text are not read.
    """
    keep = Scratch(docs.sparkSession, "packing")
    cut = keep.cut(pieces(docs, path, capacity=capacity, **settings).withColumn("ids_crc32", F.crc32("ids")))
    return place(cut, capacity, keep, ("ids_crc32",))


def sequences(cut: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, each at most ``capacity`` ids, from stored pieces and their places."""
    parts = placed.select("row", "piece", "sequence_id", "offset").join(cut.select("row", "piece", "ids"), ["row", "piece"])
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return parts.groupBy("sequence_id").agg(ordered.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda out, p: F.concat(out, p["ids"])).alias("ids")
    )
