"""Exact duplicates found through a minimal perfect hash over the digests seen so far.

The index holds, for each bucket of digests, a minimal perfect hash: a seed per cell sends the digests of that
cell to slots that no other digest has, so n digests fill exactly n slots. A slot holds the full digest, the
locator of the row that stays, and the number of its copies. A lookup goes to one slot and compares all
bytes there, so a digest that was never seen is not mistaken for one that was.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import ROW, Scratch, column, numbered

#: Digests of the history, and of the other rows, in one bucket on average; bounds what one task holds.
BUCKET = 2048
#: Stands for a missing id inside locators.
NO_ID = -(1 << 63)
_INDEX = "bucket bigint, seeds binary, digests binary, ids binary, rows binary, copies binary"
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def text_digest(text: Column) -> Column:
    """SHA-256 of the text as it is; a missing text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def _slot(key: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    return (_mixed(key + seed.astype(np.uint64) * _GOLDEN) % np.uint64(n)).astype(np.int64)


def _cells(n: int) -> int:
    return -(-n // 4)


def perfect_hash(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, slots) for distinct digests given as rows of four 64-bit words. A cell of one digest keeps its slot
    itself as -1 - slot, so the last free slots need no search."""
    n = len(words)
    cell = (words[:, 1] % np.uint64(_cells(n))).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    bounds = np.searchsorted(cell[order], np.arange(_cells(n) + 1))
    sizes = np.diff(bounds)
    seeds = np.zeros(_cells(n), np.int64)
    slots = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    for c in np.argsort(-sizes, kind="stable"):
        if sizes[c] < 2:
            break
        members = order[bounds[c] : bounds[c + 1]]
        keys, first = words[members, 2], 0
        while True:
            trial = np.arange(first, first + 64)
            places = np.sort(_slot(keys[None, :], trial[:, None], n), axis=1)
            fits = ~taken[places].any(axis=1) & (np.diff(places, axis=1) != 0).all(axis=1)
            if fits.any():
                seeds[c] = trial[fits.argmax()]
                break
            first += 64
        slots[members] = _slot(keys, seeds[c : c + 1], n)
        taken[slots[members]] = True
    single = np.flatnonzero(sizes == 1)
    free = np.flatnonzero(~taken)
    seeds[single] = -1 - free[: len(single)]
    slots[order[bounds[single]]] = free[: len(single)]
    return seeds, slots


def _words(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("digest").to_pylist()), np.uint64).reshape(-1, 4)


def _find(index: dict[str, np.ndarray], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, member) per digest; the slot of a digest that is no member means nothing."""
    n = len(index["digests"])
    seed = index["seeds"][(words[:, 1] % np.uint64(_cells(n))).astype(np.int64)]
    slot = np.where(seed < 0, -1 - seed, _slot(words[:, 2], np.maximum(seed, 0), n))
    return slot, (index["digests"][slot] == words).all(axis=1)


def _opened(table: pa.Table) -> dict[str, np.ndarray] | None:
    if not table.num_rows:
        return None
    row = table.to_pylist()[0]
    out = {k: np.frombuffer(row[k], np.int64) for k in ("seeds", "ids", "rows", "copies")}
    return out | {"digests": np.frombuffer(row["digests"], np.uint64).reshape(-1, 4), "bucket": row["bucket"]}


def _closed(bucket: int, seeds, digests, ids, rows, copies) -> pa.Table:
    arrays = {"seeds": seeds, "digests": digests, "ids": ids, "rows": rows, "copies": copies}
    blobs = {k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in arrays.items()}
    return pa.table({"bucket": pa.array([bucket], pa.int64()), **blobs})


def _build(table: pa.Table) -> pa.Table:
    words = _words(table)
    seeds, slots = perfect_hash(words)
    at = np.argsort(slots)
    locators = [table.column(k).to_numpy()[at] for k in ("id", "row", "n")]
    return _closed(table.column("bucket")[0].as_py(), seeds, words[at], *locators)


def _looked_up(index: pa.Table, asked: pa.Table) -> pa.Table:
    held, n = _opened(index), asked.num_rows
    if held is None or not n:
        empty = np.zeros(n, np.int64)
        slot, member, found = empty, np.zeros(n, bool), {k: empty for k in ("ids", "rows", "copies")}
    else:
        slot, member = _find(held, _words(asked))
        found = {k: held[k][slot] for k in ("ids", "rows", "copies")}
    return pa.table(
        {
            "bucket": asked.column("bucket").combine_chunks().cast(pa.int64()),
            "slot": pa.array(slot, pa.int64(), mask=~member),
            "digest": asked.column("digest").combine_chunks().cast(pa.binary()),
            "id": asked.column("id").combine_chunks().cast(pa.int64()),
            "row": asked.column("row").combine_chunks().cast(pa.int64()),
            "n": asked.column("n").combine_chunks().cast(pa.int64()),
            "held_id": pa.array(found["ids"], pa.int64(), mask=~member),
            "held_row": pa.array(found["rows"], pa.int64(), mask=~member),
            "held_n": pa.array(found["copies"], pa.int64(), mask=~member),
        }
    )


def _updated(index: pa.Table, hits: pa.Table) -> pa.Table:
    held = _opened(index)
    if held is None:
        return index
    slot = hits.column("slot").to_numpy()
    new = {}
    for name, value in (("ids", "id"), ("rows", "row"), ("copies", "n")):
        new[name] = held[name].copy()
        new[name][slot] = hits.column(value).to_numpy()
    return _closed(held["bucket"], held["seeds"], held["digests"], new["ids"], new["rows"], new["copies"])


def distinct_digests(rows: DataFrame, buckets: int) -> DataFrame:
    """(digest, id, row, n, bucket) from rows (digest, id, row): the largest id of equal digests, at a tie the later row, and how
    many there are. Copies are combined before the shuffle."""
    best = F.max(F.struct("id", "row")).alias("_best")
    return (
        rows.groupBy("digest")
        .agg(best, F.count(F.lit(1)).alias("n"))
        .select("digest", "_best.id", "_best.row", "n", F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket"))
    )


def build_index(digests: DataFrame) -> DataFrame:
    """Index rows from ``distinct_digests``."""
    return digests.groupBy("bucket").applyInArrow(_build, _INDEX)


def lookup(index: DataFrame, digests: DataFrame) -> DataFrame:
    """``digests`` with the slot and what it holds; all null for digests the index doesn't have."""
    schema = "bucket bigint, slot bigint, digest binary, id bigint, row bigint, n bigint, held_id bigint, held_row bigint, held_n bigint"
    return index.groupBy("bucket").cogroup(digests.groupBy("bucket")).applyInArrow(_looked_up, schema)


def update_index(index: DataFrame, hits: DataFrame) -> DataFrame:
    """``index`` with new locators and counts in the slots of ``hits`` (bucket, slot, id, row, n)."""
    return index.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(_updated, _INDEX)


def decide(rows: DataFrame, is_history: Column, buckets: int | None = None) -> DataFrame:
    """Decisions (row, id, digest, keep_id, keep_row, group_size) for rows (row, id, digest).

    Rows of the history fill the index. The other rows look themselves up; repeats of the history update its slots,
    and what is not in the index is grouped by itself. Then the history reads its slots. Of equal digests
    the largest id stays, at a tie the row read last; missing ids are the smallest.
    """
    spark = rows.sparkSession
    keep = Scratch(spark, "dedup")
    with Scratch(spark, "dedup-index") as temp:
        rows = keep.cut(rows.select("row", F.coalesce("id", F.lit(NO_ID)).alias("id"), "digest", is_history.alias("_old")))
        old, new = rows.filter("_old"), rows.filter("not _old")
        if buckets is None:
            counts = rows.groupBy("_old").count().collect()  # two rows
            buckets = max(1, -(-max((r["count"] for r in counts), default=0) // BUCKET))
        seen = temp.cut(distinct_digests(old, buckets))
        index = temp.cut(build_index(seen))
        found = temp.cut(lookup(index, distinct_digests(new, buckets)))
        best = F.greatest(F.struct("id", "row"), F.struct(F.col("held_id").alias("id"), F.col("held_row").alias("row")))
        hits = found.filter("slot is not null").select(
            "bucket", "slot", best.id.alias("id"), best.row.alias("row"), (F.col("n") + F.col("held_n")).alias("n")
        )
        index = temp.cut(update_index(index, hits))
        settled = lookup(index, seen).select("digest", "held_id", "held_row", "held_n")
        alone = found.filter("slot is null").select("digest", F.col("id"), F.col("row"), F.col("n"))
        groups = keep.cut(settled.toDF("digest", "keep_id", "keep_row", "group_size").unionByName(alone.toDF("digest", "keep_id", "keep_row", "group_size")))
    # A digest with very many rows is split by the adaptive skew join.
    joined = rows.join(groups, "digest")
    no_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return joined.select("row", no_id("id"), "digest", no_id("keep_id"), "keep_row", "group_size")


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Decisions for all ``docs``, whose rows up to about the median id are the history that fills the index.

    Missing texts equal empty ones. Repeated rows are copies of each other: one stays. An empty table gives no rows.
    Other columns are not read.
    """
    return _decided(numbered(docs), id_column, text)


def _decided(rows: DataFrame, id_column: str, text: str) -> DataFrame:
    """``exact_dedup`` of rows with a number; ``decide`` stores the numbers it reads."""
    slim = rows.select(
        F.col(ROW).alias("row"), column(rows, id_column).cast("bigint").alias("id"), text_digest(column(rows, text)).alias("digest")
    )
    middle = rows.agg(F.percentile_approx(column(rows, id_column).cast("bigint"), 0.5, 1000)).first()[0]
    return decide(slim, F.lit(False) if middle is None else F.coalesce(F.col("id") <= middle, F.lit(False)))


def without_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = Scratch(docs.sparkSession, "dedup-rows").cut(numbered(docs))
    stay = _decided(rows, id_column, text).filter("row = keep_row").select(F.col("row").alias(ROW))
    return rows.join(stay, ROW, "left_semi").drop(ROW)
