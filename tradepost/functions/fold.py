"""Sequential rules: rows of one key taken strictly in order, each depending on the state before it.

Rows are shuffled by key, sorted inside partitions and streamed through a small Python step, so a
task keeps the state of one key, not its rows. A key with more rows than one task should take
is cut into consecutive chunks that are folded side by side: each chunk starts from a guessed state,
and chunks whose true start turns out to differ are folded again. Keys that have not settled after a few
rounds are streamed through one task each. Either way the answer is that of one long pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .durable import cut
from .limits import LIMITS

CHUNK = "_chunk"
#: Rounds in which chunks may settle before their key is streamed in one pass.
ROUNDS = 3


@dataclass(frozen=True)
class State:
    """A number carried along rows with equal ``keys``: ``start`` holds it before the first of them,
    ``end`` holds it after each row. ``keys`` includes or is implied by the fold's key."""

    keys: tuple[str, ...]
    start: str
    end: str


def fold(
    rows: DataFrame,
    key: str,
    order: tuple[str, ...],
    reads: tuple[str, ...],
    writes: T.StructType,
    make_step: Callable[[], Callable[[dict[str, list]], dict[str, list]]],
    n: int = 0,
) -> DataFrame:
    """``rows`` plus the columns ``writes``. A step gets the columns ``reads`` of a run of rows, sorted by
    key, chunk and order, and returns the new columns; one step object serves a whole partition. ``n`` is the
    number of rows, if known, for which there should be tasks enough."""
    if CHUNK not in rows.columns:
        rows = rows.withColumn(CHUNK, F.lit(0))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // LIMITS.fold_rows))
    schema = T.StructType(rows.schema.fields + writes.fields)
    arrow_kinds = {"bigint": pa.int64(), "boolean": pa.bool_()}
    new_columns = [(f.name, arrow_kinds[f.dataType.simpleString()]) for f in writes.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make_step()
        for batch in batches:
            out = step({name: batch.column(name).to_pylist() for name in reads})
            arrays = [pa.array(out[name], kind) for name, kind in new_columns]
            names = batch.schema.names + [name for name, _ in new_columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=names)

    return rows.repartition(parts, key, CHUNK).sortWithinPartitions(key, CHUNK, *order).mapInArrow(run, schema)


def fold_in_order(
    rows: DataFrame,
    key: str,
    order: tuple[str, ...],
    states: list[State],
    reads: tuple[str, ...],
    writes: T.StructType,
    make_step: Callable[[], Callable[[dict[str, list]], dict[str, list]]],
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Fold of any key size; see the module text. ``rows`` has every state's ``start`` column.
    ``sizes`` may give the rows per key (key, count), or an upper bound, where that is cheaper to get."""

    sizes = rows.groupBy(key).count() if sizes is None else sizes
    long = F.when(F.col("count") > LIMITS.fold_rows, F.col("count"))
    seen = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("all"), F.count(long).alias("keys"), F.sum(long).alias("n")).first()

    def one_pass(some: DataFrame) -> DataFrame:
        return fold(some, key, order, reads, writes, make_step, seen["all"])

    if not seen["keys"]:
        return one_pass(rows).drop(CHUNK)
    large_keys = cut(sizes.filter(F.col("count") > LIMITS.fold_rows).select(key))
    light = rows.join(large_keys, key, "left_anti")
    heavy = rows.join(large_keys, key, "left_semi")
    return one_pass(light).unionByName(_by_chunks(heavy, seen["n"], key, order, states, one_pass)).drop(CHUNK)


def _by_chunks(heavy, n, key, order, states, one_pass) -> DataFrame:
    chunks = -(-2 * n // LIMITS.fold_rows)
    # Range partitions follow (key, order), so their numbers are consecutive stretches of each key.
    # The bounds come from a sample: write the split out so that every later use sees the same one.
    rows = cut(heavy.repartitionByRange(chunks, key, *order).withColumn(CHUNK, F.spark_partition_id()))
    opening = rows
    for s in states:
        first = rows.groupBy(*s.keys).agg(F.min(CHUNK).alias("_first"))
        guess = F.lit(0).cast(rows.schema[s.start].dataType)
        opening = (
            _on(opening, first, list(s.keys))
            .withColumn(s.start, F.when(F.col(CHUNK) == F.col("_first"), F.col(s.start)).otherwise(guess))
            .drop("_first")
        )
    folded = cut(one_pass(opening))
    for _ in range(ROUNDS):
        target, differs = folded, F.lit(False)
        for s in states:
            ends = folded.groupBy(*s.keys, CHUNK).agg(F.max_by(s.end, F.struct(*order)).alias("_end"))
            previous = Window.partitionBy(*s.keys).orderBy(CHUNK)
            # A state may be NULL, so a row says by itself whether another chunk comes before it.
            starts = ends.select(
                *s.keys,
                CHUNK,
                F.lag("_end").over(previous).alias(f"_true_{s.start}"),
                F.lag(F.lit(True), 1, False).over(previous).alias(f"_follows_{s.start}"),
            )
            target = target.join(starts, [*s.keys, CHUNK])
            differs = differs | (F.col(f"_follows_{s.start}") & ~F.col(f"_true_{s.start}").eqNullSafe(F.col(s.start)))
        target = target.withColumn("_differs", differs)
        stale = cut(target.filter("_differs").select(key, CHUNK).distinct())
        if stale.isEmpty():
            return folded
        again = target.join(stale, [key, CHUNK], "left_semi")
        for s in states:
            start = F.when(F.col(f"_follows_{s.start}"), F.col(f"_true_{s.start}")).otherwise(F.col(s.start))
            again = again.withColumn(s.start, start)
        # Only stale chunks are folded and written again.
        redone = cut(one_pass(again.select(*rows.columns)))
        folded = folded.join(stale, [key, CHUNK], "left_anti").unionByName(redone)
    slow = cut(stale.select(key).distinct())
    whole = one_pass(rows.join(slow, key, "left_semi").withColumn(CHUNK, F.lit(0)))
    return folded.join(slow, key, "left_anti").unionByName(whole)


def _on(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    from .joins import keyed_join

    return keyed_join(rows, side, keys[0]) if len(keys) == 1 else rows.join(side, keys)
