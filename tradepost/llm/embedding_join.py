"""Vectors whose cosine reaches a threshold, found by a pigeonhole join over blocks of rotated coordinates.

The squared distance of two unit vectors is the sum over blocks of coordinates, so of two vectors within a distance some block
lies within its share of the squared distance. Shares are proportional to the variance of the blocks. Each block is range-joined: a
tree of median splits cuts its space into boxes, a vector lives in its own box and is sent to every later box that its share
reaches, and a box compares its vectors block-wise. What passes is compared exactly, on all coordinates. A pair counts in the first
block that finds it, so no pair counts twice and none has to become a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.groups import linked_groups
from .scratch import ROW, Scratch, column, numbered

#: The rotation and the splits are fitted on this many vectors at most; they decide where vectors meet, not what is linked.
FIT_ROWS = 20_000
#: Vectors of one box, and boxes of one block, at most.
BOX_ROWS = 4096
DEPTH = 12
_SLACK = 1e-9


@dataclass(frozen=True)
class Layout:
    """Rotation and boxes. Coordinates are in blocks one after the other, widest first inside a block."""

    size: int  # coordinates of the input
    rotation: bytes
    budgets: tuple[float, ...]
    depth: int
    splits: tuple[bytes, ...]  # per block the split values, level by level
    parts: int  # stretches that a box's own vectors are dealt to
    threshold: float

    @property
    def width(self) -> int:
        return -(-self.size // len(self.budgets))


class _Space:
    def __init__(self, layout: Layout):
        self.layout = layout
        full = layout.width * len(layout.budgets)
        self.rotation = np.frombuffer(layout.rotation).reshape(layout.size, full)
        self.splits = [np.frombuffer(s) for s in layout.splits]

    def coordinates(self, units: np.ndarray) -> np.ndarray:
        return units @ self.rotation

    def boxes(self, x: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home box of each row, rows, boxes): the boxes within the block's share of each row, its home among them."""
        w, reach = self.layout.width, self.layout.budgets[block] + 2 * _SLACK
        mine = x[:, block * w : (block + 1) * w]
        home = np.zeros(len(x), np.int64)
        rows, at, far = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for level in range(self.layout.depth):
            values = self.splits[block][(1 << level) - 1 : (2 << level) - 1]
            home = 2 * home + (mine[:, level] > values[home])
            gap = mine[rows, level] - values[at]
            right = (gap > 0).astype(np.int64)
            other = far + gap * gap
            near = other <= reach
            rows, at, far = (
                np.concatenate([rows, rows[near]]),
                np.concatenate([2 * at + right, 2 * at[near] + 1 - right[near]]),
                np.concatenate([far, other[near]]),
            )
        return home, rows, at


@lru_cache(maxsize=2)
def _space(layout: Layout) -> _Space:
    return _Space(layout)


def _matrix(lists: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors in double precision, usable): rows that are null, zero or hold null or non-finite components are not usable.
    Shorter vectors are filled up with zeros."""
    n = len(lists)
    out = np.zeros((n, size))
    lists = lists.cast(pa.list_(pa.float64()))
    lengths = np.nan_to_num(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
    flat = lists.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(float)  # null components become NaN
    row = np.repeat(np.arange(n), lengths)
    first = np.cumsum(lengths) - lengths
    out[row, np.arange(len(values)) - first[row]] = values
    with np.errstate(over="ignore", invalid="ignore"):
        usable = np.isfinite(out).all(axis=1) & (out != 0).any(axis=1)
    return out, usable


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, rows: int, threshold: float, blocks: int = 4) -> Layout:
    """Layout for ``rows`` vectors from a sample of unit vectors."""
    size = sample.shape[1]
    blocks = max(1, min(blocks, size))
    width = -(-size // blocks)
    variance, vectors = np.linalg.eigh(np.cov(sample.T).reshape(size, size) if len(sample) > 1 else np.eye(size))
    order = np.argsort(-variance, kind="stable")
    rotation = np.zeros((size, width * blocks))
    shares = np.zeros(blocks)
    for i, axis in enumerate(order):  # dealt out so that blocks are about equally wide
        block = i % blocks if i // blocks % 2 == 0 else blocks - 1 - i % blocks
        rotation[:, block * width + i // blocks] = vectors[:, axis]
        shares[block] += max(variance[axis], 0)
    shares = shares / shares.sum() if shares.sum() > 0 else np.full(blocks, 1 / blocks)
    depth = 0
    while depth < min(DEPTH, width) and (rows >> depth) > BOX_ROWS:
        depth += 1
    x = sample @ rotation
    splits = []
    for block in range(blocks):
        at, values = np.zeros(len(x), np.int64), []
        for level in range(depth):
            mine = x[:, block * width + level]
            level_values = [float(np.median(mine[at == k])) if (at == k).any() else 0.0 for k in range(1 << level)]
            at = 2 * at + (mine > np.array(level_values)[at])
            values += level_values
        splits.append(np.array(values).tobytes())
    budgets = tuple(float(s) * (2 - 2 * threshold) for s in shares)
    parts = max(1, -(-rows // (BOX_ROWS << depth)))
    return Layout(size, rotation.tobytes(), budgets, depth, tuple(splits), parts, threshold)


def _digested(size: int):
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, usable = _matrix(batch.column("vector"), size)
            blobs = [(v + 0.0).tobytes() if ok else None for v, ok in zip(x, usable)]
            digests = b"".join(xxhash.xxh3_128_digest(b or b"") for b in blobs)
            both = np.frombuffer(digests, np.int64).reshape(-1, 2)
            arrays = [batch.column("row"), batch.column("id"), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _dealt(layout: Layout):
    schema = pa.schema(
        [("block", pa.int32()), ("box", pa.int64()), ("part", pa.int64()), ("guest", pa.bool_())]
        + [("node", pa.int64()), ("copies", pa.int64()), ("x", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = _space(layout)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                x = np.frombuffer(b"".join(batch.column("vector").to_pylist())).reshape(-1, layout.size)
                x = space.coordinates(_units(x))
                blobs = pa.array([v.tobytes() for v in x], pa.binary())
                node, copies = batch.column("node"), batch.column("copies")
                mine = node.to_numpy() % layout.parts
                for block in range(len(layout.budgets)):
                    home, rows, at = space.boxes(x, block)
                    for part in range(layout.parts):
                        lives = (at == home[rows]) & (mine[rows] == part)
                        visits = (at > home[rows]) | ((at == home[rows]) & (mine[rows] < part))
                        take = np.flatnonzero(lives | visits)
                        picked = pa.array(rows[take])
                        columns = [
                            pa.array(np.full(len(take), block, np.int32)),
                            pa.array(at[take].astype(np.int64)),
                            pa.array(np.full(len(take), part, np.int64)),
                            pa.array(visits[take]),
                            node.take(picked),
                            copies.take(picked),
                            blobs.take(picked),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


class _Box:
    """Vectors that live in one box; guests come in batches. Counts links and joins linked vectors to groups."""

    def __init__(self, layout: Layout, block: int, node: np.ndarray, copies: np.ndarray, x: np.ndarray):
        self.layout, self.block = layout, block
        self.node, self.copies, self.x = node, copies, x
        self.links = np.zeros(len(node), np.int64)
        self.label = np.arange(len(node))
        for a in range(0, len(node), 512):
            for left, right in self._pairs(slice(a, a + 512), self.x[a:]):
                right = right + a
                once = left < right
                left, right = left[once], right[once]
                np.add.at(self.links, left, self.copies[right])
                np.add.at(self.links, right, self.copies[left])
                self.label = _merged(self.label, left, right)

    def _pairs(self, own: slice, other: np.ndarray):
        """Linked pairs of the box's rows ``own`` and ``other``, as positions in the box and in ``other``, some at a time."""
        layout, w = self.layout, self.layout.width
        cut = slice(self.block * w, (self.block + 1) * w)
        a = self.x[own]
        budgets = np.array(layout.budgets) + _SLACK
        for start in range(0, len(other), 2048):
            b = other[start : start + 2048]
            p, q = a[:, cut], b[:, cut]
            apart = (p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (p @ q.T)
            left, right = np.nonzero(apart <= budgets[self.block] + _SLACK)
            for s in range(0, len(left), 1 << 16):
                i, j = left[s : s + (1 << 16)], right[s : s + (1 << 16)]
                gap = a[i] - b[j]
                near = (gap * gap).reshape(len(i), len(budgets), w).sum(axis=2) <= budgets
                linked = near[:, self.block] & (near.argmax(axis=1) == self.block)
                i, j = i[linked], j[linked]
                linked = (a[i] * b[j]).sum(axis=1) >= layout.threshold
                yield i[linked] + own.start, j[linked] + start

    def meet(self, node: np.ndarray, copies: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, links, root) of guests that are linked here."""
        links, n = np.zeros(len(node), np.int64), len(self.node)
        label = np.concatenate([self.label, n + np.arange(len(node))])
        for a in range(0, n, 512):
            for left, right in self._pairs(slice(a, a + 512), x):
                np.add.at(self.links, left, copies[right])
                np.add.at(links, right, self.copies[left])
                label = _merged(label, left, right + n)
        self.label = label[:n]  # a linked guest has a smaller label here, so these never name guests
        some = links > 0
        return node[some], links[some], self.node[label[n:][some]]

    def own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = self.links > 0
        return self.node[some], self.links[some], self.node[self.label[some]]


def _merged(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    while (label[left] != label[right]).any():
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while (new[new] != new).any():
            new = new[new]
        label = new[label]
    return label


def _joined(layout: Layout):
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    full = layout.width * len(layout.budgets)

    def table(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], schema=schema)

    def arrays(chunks: list[pa.RecordBatch]):
        t = pa.Table.from_batches(chunks)
        x = np.frombuffer(b"".join(t.column("x").to_pylist())).reshape(-1, full)
        return t.column("node").to_numpy(), t.column("copies").to_numpy(), x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, box = None, [], None
        for whole in batches:
            keys = np.stack([whole.column(c).to_numpy() for c in ("block", "box", "part")] + [whole.column("guest").to_numpy(zero_copy_only=False)])
            ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *ends], [*ends, whole.num_rows]):
                here, guest = tuple(keys[:3, a].tolist()), bool(keys[3, a])
                if here != key:
                    if home:
                        box = _Box(layout, key[0], *arrays(home))
                    if box is not None:
                        yield table(box.own())
                    key, home, box = here, [], None
                run_of = whole.slice(a, b - a)
                if not guest:
                    home.append(run_of)
                    continue
                if home:
                    box, home = _Box(layout, key[0], *arrays(home)), []
                if box is not None:  # guests of an empty box meet nobody
                    for s in range(0, run_of.num_rows, 2048):
                        yield table(box.meet(*arrays([run_of.slice(s, 2048)])))
        if home:
            box = _Box(layout, key[0], *arrays(home))
        if box is not None:
            yield table(box.own())

    return run


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per row of ``vectors``: row, id, n_links (other rows linked directly) and component_id (smallest id reachable over
    links, itself included).

    Two vectors are linked when their cosine reaches the threshold, in double precision. Vectors that are null, zero or hold
    null or non-finite components are linked with nothing; shorter vectors count as filled up with zeros. Equal vectors
    meet as one with a count. Missing ids are the largest. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    keep = Scratch(spark, "vectors")
    rows = numbered(vectors).select(
        F.col(ROW).alias("row"), column(vectors, id_column).cast("bigint").alias("id"), column(vectors, vector).alias("vector")
    )
    size = max(1, vectors.agg(F.max(F.size(column(vectors, vector)))).first()[0] or 1)
    with Scratch(spark, "vector-join") as temp:
        read = temp.cut(rows.mapInArrow(_digested(size), "row bigint, id bigint, d1 bigint, d2 bigint, vector binary"))
        members = keep.cut(read.withColumn("ok", F.col("vector").isNotNull()).drop("vector"))
        first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))).alias("first")
        sets = keep.cut(
            members.filter("ok").groupBy("d1", "d2").agg(first, F.count(F.lit(1)).alias("copies")).withColumn("node", F.col("first.row"))
        )
        nodes = temp.cut(
            read.select("row", "vector").join(sets.select(F.col("node").alias("row"), "copies"), "row").withColumnRenamed("row", "node")
        )
        sample = nodes.orderBy(F.xxhash64("node")).limit(FIT_ROWS).select("vector").toPandas()["vector"]
        fitted = np.frombuffer(b"".join(sample)).reshape(-1, size) if len(sample) else np.eye(size)
        layout = fit(_units(fitted), nodes.count(), threshold)
        dealt = nodes.mapInArrow(_dealt(layout), "block int, box bigint, part bigint, guest boolean, node bigint, copies bigint, x binary")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        met = temp.cut(
            dealt.repartition(n, "block", "box", "part")
            .sortWithinPartitions("block", "box", "part", "guest")
            .mapInArrow(_joined(layout), "node bigint, links bigint, root bigint")
        )
        links = met.groupBy("node").agg(F.sum("links").alias("links"))
        star = met.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()
        classes = linked_groups(star).select("node", F.col("group").alias("class"))
        found = temp.cut(
            sets.join(links, "node", "left")
            .join(classes, "node", "left")
            .withColumn("class", F.coalesce("class", "node"))
            .withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
        )
        heads = found.groupBy("class").agg(F.min("first").alias("head"))
        found = keep.cut(found.join(heads, "class").select("d1", "d2", "n_links", F.col("head.id").alias("component_id"), F.lit(True).alias("ok")))
    return members.join(found, ["d1", "d2", "ok"], "left").select(
        "row",
        "id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )
