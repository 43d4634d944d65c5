"""Byte-level BPE through a sentencepiece model that is written straight from the ranks.

Each byte of a vocabulary entry becomes one printable character; an entry's score is its negative rank and its id is its
rank, so the highest score that a merge can reach is the lowest rank. Normalisation is the identity: no added
blanks, none removed, none escaped. Words, as the pattern cuts them, are encoded each by itself. Decoding takes ids back
to pieces and characters back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ID, ChunkEncoder, byte_characters, mapped
from .scratch import ROW, column, numbered


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialize_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model. Field numbers and values are those of the public model format."""
    characters = byte_characters()
    size = max(ranks.values()) + 1
    pieces: list[bytes | None] = [None] * size
    for token, rank in ranks.items():
        pieces[rank] = "".join(characters[b] for b in token).encode()
    out = []
    for rank, piece in enumerate(pieces):
        # A rank that is not used gets a piece that no text can reach (type 5: unused).
        name, kind = (piece, 1) if piece is not None else (b"\xe2\x81\x87unused%d" % rank, 5)
        out.append(_block(1, _block(1, name) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _number(3, kind)))
    out.append(_block(1, _block(1, b"\xe2\x81\x87unknown") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2)))
    minus_one = (1 << 64) - 1
    trainer = _number(3, 2) + _number(4, size + 1) + _number(35, 0) + _number(40, size)
    trainer += b"".join(_number(field, minus_one) for field in (41, 42, 43))
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(out) + _block(2, trainer) + _block(3, normalizer)


class ByteBpe:
    """Ids of texts by ranks, and bytes of ids."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialize_model(ranks))
        # A word that is an entry as a whole has that id, also where merges would not lead to it.
        self.whole = {token: np.array([rank], ID).tobytes() for token, rank in ranks.items()}
        find, whole, encode = regex.compile(pattern).findall, self.whole, self.model.encode_as_ids

        def piece(text: str) -> bytes:
            out = []
            for word in find(text):
                ids = whole.get(word.encode("utf-8", "surrogatepass"))
                out.append(np.array(encode(mapped(word)), ID).tobytes() if ids is None else ids)
            return b"".join(out)

        self.encode = ChunkEncoder(piece)
        as_byte = {c: b for b, c in enumerate(byte_characters())}
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size() - 1)]
        self.bytes = [bytes(as_byte[c] for c in n) if n[0] in as_byte else b"" for n in names]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(packed, ID).tolist()))


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _encode(path: str, pattern: str):
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                encoded = codec.encode([t or "" for t in batch.column("text").to_pylist()])
                ends = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int32)
                ids = np.frombuffer(b"".join(encoded), np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)).cast(schema.field("ids").type)
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), lists], schema=schema)

    return run


def _decode(path: str, pattern: str):
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                lists = batch.column("ids")
                ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
                decoded = [codec.decode(flat[a:b].astype(ID).tobytes()) for a, b in zip(ends, ends[1:])]
                columns = [batch.column("row"), batch.column("id"), lists.cast(schema.field("ids").type), pa.array(decoded, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, ids) for all ``docs``. Missing and empty texts have no ids; strings of special tokens are ordinary text.
    Repeated rows are encoded each for itself, an empty table gives no rows, other columns are not read."""
    rows = numbered(docs).select(
        F.col(ROW).alias("row"), column(docs, id_column).cast("bigint").alias("id"), column(docs, text).alias("text")
    )
    return rows.mapInArrow(_encode(path, pattern), "row bigint, id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` (row, id, ids) plus ``decoded``, the bytes."""
    return encoded.mapInArrow(_decode(path, pattern), "row bigint, id bigint, ids array<int>, decoded binary")
