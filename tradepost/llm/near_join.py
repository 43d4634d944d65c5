"""Texts whose sets of word n-grams overlap: an n-gram Jaccard join with Bayesian pruning of candidates.

1. Every text gets MinHash values of its n-gram set. Texts with equal sets are one node from here on.
2. Nodes that agree on all values of some band are candidates. Bands only say which nodes have to meet: nodes
   connected over bands form an area, and an area is cut into blocks that meet block against block, so no task
   holds more than two blocks however large an area is and no pair ever becomes a row.
3. Where two blocks meet, MinHash values of candidate pairs are compared step by step. A pair is dropped once the
   posterior probability that its similarity reaches the threshold, given the agreements so far, is below a
   tolerance. What is left is compared exactly on the n-gram sets.
4. Links are counted per node, and linked nodes form classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.groups import linked_groups
from .scratch import ROW, Scratch, column, numbered

_ODD = np.uint64(0x9FB21C651E98DF25)
_STEP = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Settings:
    words: int = 5
    threshold: float = 0.8
    bands: int = 36
    values: int = 6  # per band: at 0.8 a pair shares no band with probability 0.00002
    compared: int = 24  # values per step of the pruning
    tolerance: float = 1e-6
    block: int = 256
    remembered: int = 1 << 18  # word hashes a task keeps


class _WordHashes(dict):
    def __init__(self, most: int):
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * _STEP
    return x ^ (x >> np.uint64(32))


class Sketcher:
    """N-gram sets, MinHash values and band keys of texts."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.hash = _WordHashes(settings.remembered)
        rng = np.random.default_rng(20)
        n = settings.bands * settings.values
        self.a = (rng.integers(0, 1 << 31, n, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint32)

    def grams(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the runs of ``words`` lower-case words between blanks; all words of a shorter
        text are one run; a text without words has none."""
        words = (text or "").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        k = min(self.s.words, len(words))
        h = np.fromiter(map(self.hash.__getitem__, words), np.uint64, len(words))
        runs = np.zeros(len(words) - k + 1, np.uint64)
        for i in range(k):
            runs = _mix(runs + h[i : len(words) - k + 1 + i])
        return np.unique(runs)

    def values(self, grams: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.uint32(0xFFFFFFFF))
        short = (grams >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(short), 512):
            tried = np.multiply.outer(self.a, short[i : i + 512])
            tried += self.b[:, None]
            np.minimum(low, tried.min(axis=1), out=low)
        return low

    def keys(self, values: np.ndarray) -> np.ndarray:
        """One key per band for rows of MinHash values."""
        bands = values.reshape(len(values), self.s.bands, self.s.values).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, self.s.bands + 1, dtype=np.uint64) * _STEP, bands.shape[:2]).copy()
        for i in range(self.s.values):
            key = _mix(key + bands[:, :, i])
        return key


def least_agreements(settings: Settings) -> list[tuple[int, int]]:
    """(values compared, agreements needed) per step. With every similarity equally likely beforehand, the posterior after m of
    n agreements is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum."""
    steps, t = [], settings.threshold
    for n in range(settings.compared, settings.bands * settings.values + 1, settings.compared):
        tail, m = 0.0, 0
        for m in range(n + 1):
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= settings.tolerance:
                break
        steps.append((n, m))
    return steps


def _sketch(settings: Settings):
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(settings)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                digests, values, counts = [], [], []
                for text in batch.column("text"):
                    grams = sketcher.grams(text.as_py())
                    digests.append(xxhash.xxh3_128_digest(grams.tobytes()))
                    if len(grams):
                        values.append(sketcher.values(grams))
                    counts.append(settings.bands if len(grams) else 0)
                keys = sketcher.keys(np.array(values)) if values else np.empty(0, np.uint64)
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
                arrays = [batch.column("row"), batch.column("id"), pa.array(both[:, 0]), pa.array(both[:, 1]), lists]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)

    return run


class _Block:
    def __init__(self, sketcher: Sketcher, rows: list[tuple[int, int, str]]):
        self.node = np.array([r[0] for r in rows], np.int64)
        self.copies = np.array([r[1] for r in rows], np.int64)
        self.grams = [sketcher.grams(r[2]) for r in rows]
        self.size = np.array([len(g) for g in self.grams], np.int64)
        self.values = np.array([sketcher.values(g) for g in self.grams]).reshape(len(rows), -1)
        self.keys = sketcher.keys(self.values)


def _shared(a: _Block, b: _Block, left: np.ndarray, right: np.ndarray, width: int = 8192) -> np.ndarray:
    """Common n-grams of the pairs (left, right), exactly. Few pairs are merged one by one, many through 0/1 matrices over the
    n-grams that both sides have, some columns at a time."""
    if len(left) <= 4 * (len(a.node) + len(b.node)):
        return np.array([len(np.intersect1d(a.grams[i], b.grams[j], assume_unique=True)) for i, j in zip(left, right)], np.int64)
    common = np.intersect1d(np.unique(np.concatenate(a.grams)), np.unique(np.concatenate(b.grams)), assume_unique=True)
    total = np.zeros((len(a.node), len(b.node)), np.float32)  # counts below 2^24 are exact
    places = []
    for block in (a, b):
        who = np.repeat(np.arange(len(block.node)), block.size)
        every = np.concatenate(block.grams)
        at = np.searchsorted(common, every)
        known = (at < len(common)) & (common[np.minimum(at, len(common) - 1)] == every)
        order = np.argsort(at[known], kind="stable")
        places.append((at[known][order], who[known][order]))
    for start in range(0, len(common), width):
        sides = []
        for block, (at, who) in zip((a, b), places):
            lo, hi = np.searchsorted(at, [start, start + width])
            dense = np.zeros((len(block.node), min(width, len(common) - start)), np.float32)
            dense[who[lo:hi], at[lo:hi] - start] = 1
            sides.append(dense)
        total += sides[0] @ sides[1].T
    return total[left, right].astype(np.int64)


def links_between(a: _Block, b: _Block, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs; within one block each pair once."""
    met = np.zeros((len(a.node), len(b.node)), bool)
    for band in range(settings.bands):
        met |= a.keys[:, band][:, None] == b.keys[:, band][None, :]
    if a is b:
        met = np.triu(met, 1)
    left, right = np.nonzero(met)
    agreed, done = np.zeros(len(left), np.int64), 0
    for n, least in least_agreements(settings):
        agreed += (a.values[left, done:n] == b.values[right, done:n]).sum(axis=1)
        stays = agreed >= least
        left, right, agreed, done = left[stays], right[stays], agreed[stays], n
    if not len(left):
        return left, right
    both = _shared(a, b, left, right)
    linked = both / (a.size[left] + b.size[right] - both) >= settings.threshold
    return left[linked], right[linked]


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest position reachable over links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(settings: Settings):
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def meeting(sketcher: Sketcher, task: tuple, rows: list[tuple]) -> pa.RecordBatch:
        first = _Block(sketcher, [r[1:] for r in rows if r[0] == task[1]])
        second = first if task[1] == task[2] else _Block(sketcher, [r[1:] for r in rows if r[0] == task[2]])
        left, right = links_between(first, second, settings)
        if second is first:
            node, copies, shift = first.node, first.copies, 0
        else:
            node, copies = np.concatenate([first.node, second.node]), np.concatenate([first.copies, second.copies])
            shift = len(first.node)
        right = right + shift
        links = np.zeros(len(node), np.int64)
        np.add.at(links, left, copies[right])
        np.add.at(links, right, copies[left])
        root = node[_roots(len(node), left, right)]
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (node, links, root)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, task, rows = Sketcher(settings), None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("area", "i", "j", "block", "node", "copies", "text"))
            for area, i, j, block, node, copies, text in zip(*columns):
                if (area, i, j) != task:
                    if len(rows) > 1:
                        yield meeting(sketcher, task, rows)
                    task, rows = (area, i, j), []
                rows.append((block, node, copies, text))
        if len(rows) > 1:
            yield meeting(sketcher, task, rows)

    return run


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same nodes as ``edges``: each a keeps only its smallest b, and its other neighbours are tied to
    that one instead. Nodes of one large group share most of their neighbours, so little more than one edge per node is left."""
    least = F.min("b").over(Window.partitionBy("a"))
    tied = edges.select("a", "b", least.alias("least"))
    return tied.select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """One row per row of ``docs``: row, id, class_id (smallest id of the class), n_links (other rows it is linked with
    directly, copies counted) and kept (the row with the smallest id of its class, at a tie the one read first).

    Texts are linked when the Jaccard similarity of their n-gram sets reaches the threshold; a class is what is connected
    over links. Missing, empty and blank texts have the empty set; equal sets, also empty ones, are linked.
    Missing ids are the largest. An empty table gives no rows; other columns are not read.
    """
    slim = numbered(docs).select(
        F.col(ROW).alias("row"), column(docs, id_column).cast("bigint").alias("id"), column(docs, text).alias("text")
    )
    with Scratch(docs.sparkSession, "near-rows") as temp:
        return _near(temp.cut(slim), settings)


def _near(rows: DataFrame, settings: Settings) -> DataFrame:
    """``near_duplicates`` of stored rows (row, id, text); they are not needed for reading the result."""
    spark = rows.sparkSession
    keep = Scratch(spark, "near")
    with Scratch(spark, "near-candidates") as temp:
        sketched = temp.cut(rows.mapInArrow(_sketch(settings), "row bigint, id bigint, d1 bigint, d2 bigint, keys array<bigint>"))
        first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))).alias("first")
        sets = keep.cut(
            sketched.groupBy("d1", "d2").agg(first, F.count(F.lit(1)).alias("copies")).withColumn("node", F.col("first.row"))
        )
        owners = sets.select(F.col("node").alias("row"))
        keys = sketched.select("row", "keys").join(owners, "row").select(F.col("row").alias("node"), F.explode("keys").alias("key"))
        shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        meets = keys.join(shared, "key").filter("node != low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
        areas = linked_groups(contracted(meets)).select("node", F.col("group").alias("area"))  # stored already
        counts = areas.groupBy("area").agg(F.ceil(F.count(F.lit(1)) / settings.block).alias("blocks"))
        dealt = (
            areas.join(counts, "area")
            .join(sets.select("node", "copies"), "node")
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        )
        # A node goes to every task that its block has a part in.
        other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
        texts = rows.select(F.col("row").alias("node"), "text").join(dealt, "node")
        tasks = texts.select("area", "node", "copies", "text", "block", other).select(
            "area", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "text"
        )
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        met = temp.cut(
            tasks.repartition(n, "area", "i", "j")
            .sortWithinPartitions("area", "i", "j")
            .mapInArrow(_verify(settings), "node bigint, links bigint, root bigint")
        )
        links = met.groupBy("node").agg(F.sum("links").alias("links"))
        star = met.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()
        classes = linked_groups(contracted(star)).select("node", F.col("group").alias("class"))
        nodes = (
            sets.join(links, "node", "left")
            .join(classes, "node", "left")
            .withColumn("class", F.coalesce("class", "node"))
            .withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
        )
        nodes = temp.cut(nodes)
        heads = nodes.groupBy("class").agg(F.min("first").alias("head"))
        nodes = keep.cut(nodes.join(heads, "class").select("d1", "d2", "n_links", "head"))
        members = keep.cut(sketched.select("row", "id", "d1", "d2"))
    return members.join(nodes, ["d1", "d2"]).select(
        "row", "id", F.col("head.id").alias("class_id"), "n_links", (F.col("row") == F.col("head.row")).alias("kept")
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = Scratch(docs.sparkSession, "near-rows").cut(numbered(docs))
    slim = rows.select(F.col(ROW).alias("row"), column(rows, id_column).cast("bigint").alias("id"), column(rows, text).alias("text"))
    stay = _near(slim, settings).filter("kept").select(F.col("row").alias(ROW))
    return rows.join(stay, ROW, "left_semi").drop(ROW)
