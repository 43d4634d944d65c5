"""Token ids in files: every document compressed by itself with a dictionary shared by all.

A segment is a file of its own, kept as one value of a stored table so that Spark's writers commit it whole or not at
all, in any store Spark can write to. It has the layout

    magic "TPSEG1" | dictionary hash (8 bytes) | number of documents (u4) | offsets (u8 each, one more than documents)
    | ids per document (u4 each) | frames

all little-endian. A frame is the zstandard compression of one document's ids with the dictionary that the hash names.
Segments follow each other in ascending order of document ids; the column ``before`` of the table is the number of
ids before the segment in its part, and ``starts`` has the ids before each part. A short document is read by its two offsets and one frame, without the rest of its segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zlib
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunks import ID, document_encoder
from .scratch import Scratch, column

MAGIC = b"TPSEG1"
#: The dictionary is fitted on about this many short documents, spread over all ids; everything else covers all rows.
SAMPLE = 1000
SAMPLE_CHARS = 8192
DICTIONARY_BYTES = 1 << 16
#: A segment is closed once its frames pass this size.
SEGMENT_BYTES = 4 << 20
_SEGMENT = "part int, nth int, before bigint, doc_ids binary, missing binary, n_ids bigint, body binary"


def dictionary_hash(dictionary: bytes) -> int:
    return xxhash.xxh64_intdigest(dictionary)


def narrow(packed: bytes) -> bytes:
    """Ids as they are compressed: two bytes each, or four with a leading mark if one does not fit."""
    ids = np.frombuffer(packed, ID)
    return b"\0" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\1" + packed


def widened(data: bytes) -> bytes:
    return np.frombuffer(data, "<u2", offset=1).astype(ID).tobytes() if data[:1] == b"\0" else data[1:]


def _train(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for b in batches for t in b.column("text").to_pylist()]
        end = np.array([end_id], ID).tobytes()
        samples = [narrow(ids + end) for ids in document_encoder(path)(texts)]
        total = sum(map(len, samples))
        try:
            size = min(DICTIONARY_BYTES, max(256, total // 8))
            trained = zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b""
        except zstandard.ZstdError:  # too little to learn from
            trained = b""
        yield pa.RecordBatch.from_arrays([pa.array([trained], pa.binary())], names=["dictionary"])

    return run


def train(rows: DataFrame, path: str, end_id: int) -> bytes:
    """Dictionary for rows (id, text), fitted in one task on a sample of at most 2 x ``SAMPLE`` texts of at most ``SAMPLE_CHARS``
    characters. Empty when there is too little to learn from."""
    short = rows.filter(F.length("text").between(1, SAMPLE_CHARS))
    share = 1 << 20
    n = max(1, short.count())
    picked = short.filter(F.pmod(F.xxhash64("id"), F.lit(share)) < min(share, SAMPLE * share // n + 1)).limit(2 * SAMPLE)
    trained = picked.select("text").coalesce(1).mapInArrow(_train(path, end_id), "dictionary binary").first()
    return bytes(trained[0]) if trained else b""


def _raw(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


class SegmentWriter:
    def __init__(self, dictionary: bytes, level: int = 3):
        self.hash = dictionary_hash(dictionary)
        held = _raw(dictionary)
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=held).compress
        self.clear()

    def clear(self) -> None:
        self.frames: list[bytes] = []
        self.counts: list[int] = []
        self.docs: list[int | None] = []
        self.size = 0

    def add(self, doc: int | None, packed: bytes) -> None:
        frame = self.compress(narrow(packed))
        self.frames.append(frame)
        self.counts.append(len(packed) // 4)
        self.docs.append(doc)
        self.size += len(frame)

    def body(self) -> bytes:
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in self.frames])]).astype("<u8")
        head = MAGIC + self.hash.to_bytes(8, "little") + len(self.frames).to_bytes(4, "little")
        return head + offsets.tobytes() + np.array(self.counts, "<u4").tobytes() + b"".join(self.frames)


class Segment:
    """A segment opened for reading single documents."""

    def __init__(self, body: bytes, dictionary: bytes):
        if body[:6] != MAGIC:
            raise ValueError("no segment")
        if int.from_bytes(body[6:14], "little") != dictionary_hash(dictionary):
            raise ValueError("the segment was written with another dictionary")
        self.n = int.from_bytes(body[14:18], "little")
        self.offsets = np.frombuffer(body, "<u8", self.n + 1, 18)
        self.counts = np.frombuffer(body, "<u4", self.n, 18 + 8 * (self.n + 1))
        self.frames = memoryview(body)[18 + 8 * (self.n + 1) + 4 * self.n :]
        held = _raw(dictionary)
        self.decompress = zstandard.ZstdDecompressor(dict_data=held).decompress

    def ids(self, i: int) -> bytes:
        """Packed ids of document ``i``."""
        frame = self.frames[int(self.offsets[i]) : int(self.offsets[i + 1])]
        packed = widened(self.decompress(frame))
        if len(packed) != 4 * int(self.counts[i]):
            raise ValueError("a frame does not hold the ids its index names")
        return packed


def _write(path: str, end_id: int, dictionary: bytes):
    end = np.array([end_id], ID).tobytes()
    schema = pa.schema(
        [("part", pa.int32()), ("nth", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.binary()), ("missing", pa.binary()), ("n_ids", pa.int64()), ("body", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = document_encoder(path), SegmentWriter(dictionary)
        part, nth, before = TaskContext.get().partitionId(), 0, 0

        def closed() -> pa.RecordBatch:
            missing = np.array([d is None for d in writer.docs], np.uint8).tobytes()
            ids = np.array([d or 0 for d in writer.docs], "<i8").tobytes()
            row = (part, nth, before, ids, missing, sum(writer.counts), writer.body())
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                encoded = encode([t or "" for t in batch.column("text").to_pylist()])
                for doc, packed in zip(batch.column("id").to_pylist(), encoded):
                    writer.add(doc, packed + end)
                    if writer.size >= SEGMENT_BYTES:
                        yield closed()
                        nth, before = nth + 1, before + sum(writer.counts)
                        writer.clear()
        if writer.frames:
            yield closed()

    return run


def write_files(docs: DataFrame, path: str, folder: str, end_id: int = 2, id_column: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all ``docs`` in ascending order of ids (missing ones first, equal ones in the order read) below
    ``folder``: ``dictionary``, ``segments`` and ``starts`` (part, start), the ids before the first segment of a part.

    Missing and empty texts hold the end id only. An empty table writes empty files. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(column(docs, id_column).cast("bigint").alias("id"), column(docs, text).alias("text"))
    dictionary = train(rows, path, end_id)
    spark.createDataFrame([(dictionary,)], "dictionary binary").write.parquet(f"{folder}/dictionary")
    line = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange("id", "_read")
    segments = line.sortWithinPartitions("id", "_read").select("id", "text").mapInArrow(_write(path, end_id, dictionary), _SEGMENT)
    segments.write.option("compression", "none").parquet(f"{folder}/segments")
    sizes = spark.read.schema(_SEGMENT).parquet(f"{folder}/segments").groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    sizes.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).cast("bigint").alias("start")).write.parquet(f"{folder}/starts")


def _read(dictionary: bytes):
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                segment = Segment(row["body"], dictionary)
                counts = segment.counts.astype(np.int64)
                starts = row["start"] + np.cumsum(counts) - counts
                docs = np.frombuffer(row["doc_ids"], "<i8")
                missing = np.frombuffer(row["missing"], np.uint8).astype(bool)
                for a in range(0, segment.n, 512):
                    b = min(a + 512, segment.n)
                    ids = pa.array([segment.ids(i) for i in range(a, b)], pa.binary())
                    columns = [pa.array(docs[a:b], pa.int64(), mask=missing[a:b]), pa.array(starts[a:b]), pa.array(counts[a:b]), ids]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def read_files(spark, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids) of every document from the files; ``ids`` are little-endian unsigned 32-bit integers and
    ``start`` is the number of ids of all documents before."""
    dictionary = bytes(spark.read.schema("dictionary binary").parquet(f"{folder}/dictionary").first()[0])
    starts = spark.read.schema("part int, start bigint").parquet(f"{folder}/starts")  # one row per part
    segments = spark.read.schema(_SEGMENT).parquet(f"{folder}/segments").join(F.broadcast(starts), "part")
    segments = segments.select("doc_ids", "missing", "body", (F.col("start") + F.col("before")).alias("start"))
    return segments.mapInArrow(_read(dictionary), "id bigint, start bigint, n_tokens bigint, ids binary")


def token_files(docs: DataFrame, path: str, **settings) -> DataFrame:
    """Write the files of ``docs`` into the shared folder and read them back."""
    keep = Scratch(docs.sparkSession, "token-files")
    write_files(docs, path, keep.path, **settings)
    return read_files(docs.sparkSession, keep.path)
