"""WARC archives of web pages, written and read as a table of chunks.

A payload is cut into chunks before anything handles it as a whole: a row is (record, chunk number, bytes), however large the
record. Rows of one record follow each other, and a digest is carried from chunk to chunk; every row holds the digest of
the payload up to its end, so a reader can check each chunk as it comes and tell where a payload was damaged.

Records with equal payloads are found by digest. The one with the smallest id is the response, the others revisit it and hold
no payload. A task leaves out payloads that it has already passed on for a smaller id, and the rest is decided by a
minimum per digest, so payloads that very many records share are not shuffled with each record.

Files are written by Spark's text writer, so they are committed whole or not at all in any store. Their lines are gzip members, and
the line separator is an empty gzip member: a file is a plain .warc.gz, which any gzip reader reads. A record that fits in a chunk is
one member, as the format recommends; the member of every further chunk follows. Record number, chunk number and running
digest stand in the member's extra field, which other readers skip. Read with the same separator, a file is split anywhere and
comes back as rows of chunks, in any order.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote
from uuid import UUID, uuid4

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, column

#: Bytes of payload in a chunk.
CHUNK = 1 << 20
#: Payloads that a task remembers at a time.
REMEMBERED = 1 << 17
#: An empty gzip member; the time in its head is not used by others.
SEPARATOR = bytes.fromhex("1f8b0800" "54504152" "02ff" "0300" "0000000000000000")
#: Extra field of a member: mark, size of the rest, record, chunk, whether it is the last, running digest.
_EXTRA = "<2sHqiB20s"
_MARK = b"TC"
_FORMAT = {"lineSep": SEPARATOR.decode("latin-1"), "encoding": "ISO-8859-1"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_CHUNKS = pa.schema(
    [
        ("row", pa.int64()),
        ("nth", pa.int32()),
        ("last", pa.bool_()),
        ("id", pa.int64()),
        ("url", pa.string()),
        ("bytes", pa.binary()),
        ("size", pa.int64()),
        ("digest", pa.binary()),
        ("check", pa.binary()),
    ]
)
_CHUNKS_SQL = "row bigint, nth int, last boolean, id bigint, url string, bytes binary, size bigint, digest binary, check binary"


def cut_payloads(pages: DataFrame, id_column: str, url: str, payload: str, chunk: int) -> DataFrame:
    """(row, id, url, nth, last, bytes): the payload of each row, at least one chunk, chunks of a row in order."""
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"),
        column(pages, id_column).cast("bigint").alias("id"),
        column(pages, url).cast("string").alias("url"),
        F.coalesce(column(pages, payload).cast("binary"), F.lit(b"")).alias("payload"),
    )
    last = F.expr(f"cast(greatest(0, (octet_length(payload) - 1) div {chunk}) as int)")
    cut = rows.withColumn("of", last).select("*", F.explode(F.sequence(F.lit(0), "of")).alias("nth"))
    part = F.expr(f"substring(payload, nth * {chunk} + 1, {chunk})")
    return cut.select("row", "id", "url", "nth", (F.col("nth") == F.col("of")).alias("last"), part.alias("bytes"))


def _key(row: int, page: int | None) -> tuple:
    return page is None, page or 0, row


def _carry(least: int, remembered: int):
    """Digests carried along the chunks of each record. ``bytes`` is missing where the same payload, of at least ``least`` bytes, was
    passed on for a smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: dict[bytes, tuple] = {}
        digest = check = None
        size = 0
        for batch in batches:
            data, out = batch.to_pydict(), {"bytes": [], "size": [], "digest": [], "check": []}
            for row, page, nth, last, part in zip(data["row"], data["id"], data["nth"], data["last"], data["bytes"]):
                if nth == 0:
                    digest, check, size = hashlib.sha1(), xxhash.xxh3_128(), 0
                digest.update(part)
                check.update(part)
                size += len(part)
                so_far, other = digest.digest(), check.digest()
                if nth == 0 and last and size >= least:
                    seen, own = passed.get(so_far + other), _key(row, page)
                    if seen is not None and seen < own:
                        part = None
                    else:
                        if len(passed) >= remembered:
                            passed.clear()
                        passed[so_far + other] = own
                for name, value in zip(out, (part, size, so_far, other if last else None)):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict({f.name: out.get(f.name, data.get(f.name)) for f in _CHUNKS}, schema=_CHUNKS)

    return run


def member(data: bytes, extra: bytes = b"") -> bytes:
    """A gzip member of ``data`` that does not hold the separator."""
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08" + (b"\x04" if extra else b"\0") + b"\0\0\0\0\0\xff" + (struct.pack("<H", len(extra)) + extra if extra else b"")
    for level, strategy in ((6, zlib.Z_DEFAULT_STRATEGY), (9, zlib.Z_DEFAULT_STRATEGY), (6, zlib.Z_FIXED)):
        pressed = zlib.compressobj(level, zlib.DEFLATED, -15, 9, strategy)
        out = head + pressed.compress(data) + pressed.flush() + tail
        if SEPARATOR not in out:
            return out
    raise ValueError("a chunk holds the separator in every form")


def extra_field(record: int, nth: int, last: bool, running: bytes) -> bytes:
    return struct.pack(_EXTRA, _MARK, struct.calcsize(_EXTRA) - 4, record, nth, last, running)


def opened(line: bytes) -> tuple[int, int, bool, bytes, bytes]:
    """(record, chunk, whether it is the last, running digest, data) of a member written here."""
    size = struct.unpack_from("<H", line, 10)[0]
    mark, _, record, nth, last, digest = struct.unpack_from(_EXTRA, line, 12)
    if line[:4] != b"\x1f\x8b\x08\x04" or mark != _MARK:
        raise ValueError("no chunk of an archive")
    unpack = zlib.decompressobj(-15)
    data = unpack.decompress(line[12 + size :]) + unpack.flush()
    crc, length = struct.unpack("<II", unpack.unused_data[:8])
    if zlib.crc32(data) != crc or len(data) & 0xFFFFFFFF != length:
        raise ValueError("a chunk is damaged")
    return record, nth, bool(last), digest, data


def record_id(archive: bytes, row: int) -> str:
    return UUID(bytes=hashlib.sha1(archive + struct.pack("<q", row)).digest()[:16], version=5).urn


def _line(text: str) -> str:
    """``text`` as the value of a header: a URI has no blanks, controls or characters beyond ASCII."""
    return quote(text, safe="!#$%&'()*+,/:;=?@[]~-._")


def headers(kind: str, record: str, date: str, url: str | None, page: int | None, digest: str, size: int, refers_to: str | None) -> bytes:
    """Heads of the record and of the HTTP answer in it, up to the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _line(url or "about:blank")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-Id", page),
        ("WARC-Profile", PROFILE if refers_to else None),
        ("WARC-Refers-To", f"<{refers_to}>" if refers_to else None),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(http) + (0 if refers_to else size)),
    ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode() + http


def _members(archive: bytes, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                data = r["bytes"] or b""
                if r["nth"] == 0:
                    revisit = r["first_row"] != r["row"]
                    digest = base64.b32encode(r["whole"]).decode()
                    refers = record_id(archive, r["first_row"]) if revisit else None
                    kind = "revisit" if revisit else "response"
                    data = headers(kind, record_id(archive, r["row"]), date, r["url"], r["id"], digest, r["whole_size"], refers) + data
                if r["last"]:
                    data += b"\r\n\r\n"
                out.append(member(data, extra_field(r["row"], r["nth"], r["last"], r["digest"])))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return run


def write_archive(
    pages: DataFrame,
    folder: str,
    id_column: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least: int = 0,
    chunk: int = CHUNK,
    date: str | None = None,
) -> None:
    """Write a record per row of ``pages`` below ``folder``, which must not exist.

    Of records with equal payloads of at least ``least`` bytes the one with the smallest id (missing ones last; at a tie the one read
    first) is the response and the others revisit it; smaller payloads are all responses. Missing payloads are empty ones. Missing
    URLs become ``about:blank``, missing ids have no header. Repeated rows are records of their own, an empty table writes no records, and other
    columns are not read. No step holds more than a chunk of a payload besides the row that it is read from.
    """
    spark = pages.sparkSession
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    archive = uuid4().bytes
    with Scratch(spark, "warc-chunks") as temp:
        cut = cut_payloads(pages, id_column, url, payload, chunk)
        chunks = temp.cut(cut.mapInArrow(_carry(least, REMEMBERED), _CHUNKS_SQL))
        records = chunks.filter("last").select("row", "id", "url", "nth", "size", "digest", "check")
        order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
        firsts = records.groupBy("digest", "check").agg(F.min(order).alias("first"))
        # A record below the least size is its own first.
        first_row = F.when(F.col("size") >= least, F.col("first.row")).otherwise(F.col("row"))
        decided = temp.cut(
            records.join(firsts, ["digest", "check"]).select(
                "row", "id", "url", first_row.alias("first_row"), F.col("digest").alias("whole"), F.col("size").alias("whole_size")
            )
        )
        heads = decided.select("row", "first_row", "whole", "whole_size")
        wanted = ["row", "nth", "last", "id", "url", "bytes", "digest", "first_row", "whole", "whole_size"]
        # Dealt by record and sorted, so that the chunks of a record follow each other in one file.
        responses = (
            chunks.filter("bytes is not null")
            .select("row", "nth", "last", "id", "url", "bytes", "digest")
            .repartition("row")
            .join(heads.filter("row = first_row"), "row")
            .select(wanted)
            .sortWithinPartitions("row", "nth")
        )
        one = {"nth": F.lit(0), "last": F.lit(True), "bytes": F.lit(None).cast("binary"), "digest": F.col("whole")}
        revisits = decided.filter("row != first_row").withColumns(one).select(wanted)
        lines = responses.unionByName(revisits).mapInArrow(_members(archive, date), "value binary")
        lines.select(F.col("value").cast("string")).write.options(**_FORMAT).text(folder)


_OPENED = pa.schema(
    [
        ("record", pa.int64()),
        ("nth", pa.int32()),
        ("last", pa.bool_()),
        ("running", pa.binary()),
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("date", pa.string()),
        ("url", pa.string()),
        ("id", pa.int64()),
        ("refers_to", pa.string()),
        ("declared_digest", pa.string()),
        ("declared_bytes", pa.int64()),
        ("payload", pa.binary()),
        ("n_bytes", pa.int64()),
        ("digest", pa.binary()),  # of the payload, where the row holds all of it
    ]
)
_OPENED_SQL = (
    "record bigint, nth int, last boolean, running binary, record_id string, record_type string, date string, url string, id bigint, "
    "refers_to string, declared_digest string, declared_bytes bigint, payload binary, n_bytes bigint, digest binary"
)


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if line)


def _open(payloads: bool):
    def parsed(line: bytes) -> dict:
        record, nth, last, running, data = opened(line)
        row = {"record": record, "nth": nth, "last": last, "running": running}
        if last:
            if data[-4:] != b"\r\n\r\n":
                raise ValueError("a record does not end where it should")
            data = data[:-4]
        if nth == 0:
            warc, http, data = (data + b"").split(b"\r\n\r\n", 2)
            warc, http = _fields(warc), _fields(http)
            row["record_id"] = warc["WARC-Record-ID"].strip("<>")
            row["record_type"], row["date"], row["url"] = warc["WARC-Type"], warc["WARC-Date"], warc["WARC-Target-URI"]
            row["id"] = int(warc["X-Page-Id"]) if "X-Page-Id" in warc else None
            row["refers_to"] = warc["WARC-Refers-To"].strip("<>") if "WARC-Refers-To" in warc else None
            row["declared_digest"] = warc["WARC-Payload-Digest"].removeprefix("sha1:")
            row["declared_bytes"] = int(http["Content-Length"])
        row["n_bytes"] = len(data)
        whole = nth == 0 and last
        if whole:
            row["digest"] = hashlib.sha1(data).digest()
        if payloads or not whole:
            row["payload"] = data
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parsed(line) for line in batch.column("line").to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=_OPENED)

    return run


def read_chunks(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The archives below ``folder`` as rows of chunks, in any order: record (a number), nth, last, running (SHA-1 of the payload up to
    the end of this chunk, as the writer carried it), payload, n_bytes; in the first chunk also the headers; digest where the row holds
    the whole payload. Without ``payloads`` only chunks of larger records hold bytes."""
    lines = spark.read.options(**_FORMAT).text(folder).select(F.col("value").cast("binary").alias("line")).filter(F.length("line") > 0)
    return lines.mapInArrow(_open(payloads), _OPENED_SQL)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record, n_bytes, digest, intact) from chunks that come record by record, in order."""
    schema = pa.schema([("record", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.binary()), ("intact", pa.bool_())])
    record, digest, size, at, intact = None, None, 0, 0, True
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["record"] != record:
                record, digest, size, at, intact = r["record"], hashlib.sha1(), 0, 0, True
            digest.update(r["payload"])
            size += len(r["payload"])
            intact = intact and r["nth"] == at and digest.digest() == r["running"]
            at += 1
            if r["last"]:
                out.append({"record": record, "n_bytes": size, "digest": digest.digest(), "intact": intact})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def base32(digest: Column) -> Column:
    """Bare upper-case base32 of 20 bytes, by DataFrame functions: five bytes are eight characters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    characters = []
    for part in range(4):
        number = F.conv(F.hex(F.substring(digest, 5 * part + 1, 5)), 16, 10).cast("bigint")
        for k in range(8):
            characters.append(F.substring(F.lit(letters), (F.shiftright(number, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)))
    return F.concat(*characters)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives below ``folder``: record_id, record_type, date, url, id, refers_to (record id), refers_to_id
    (that record's id), payload_bytes and payload_digest of the full payload, and intact.

    Digests of responses are made from the payloads read; a record in several chunks is put in order and its digest carried from chunk to
    chunk, so no payload is held whole. Revisits have the size and digest that they declare; intact says that what was read agrees with
    the headers, for revisits with those of the response.
    """
    keep = Scratch(spark, "warc-records")
    chunks = keep.cut(read_chunks(spark, folder, payloads=False))
    heads = chunks.filter("nth = 0")
    larger = (
        chunks.filter("not (nth = 0 and last)")
        .select("record", "nth", "last", "running", "payload")
        .repartition("record")
        .sortWithinPartitions("record", "nth")
        .mapInArrow(_digest, "record bigint, n_bytes bigint, digest binary, intact boolean")
    )
    found = chunks.filter("nth = 0 and last").select("record", "n_bytes", "digest", (F.col("digest") == F.col("running")).alias("intact"))
    found = found.unionByName(larger)
    own = ["record_id", "date", "url", "id"]
    responses = heads.filter("record_type = 'response'").drop("last", "n_bytes", "digest").join(found, "record")
    told = (F.col("n_bytes") == F.col("declared_bytes")) & (base32(F.col("digest")) == F.col("declared_digest"))
    responses = responses.select(
        *own,
        "record_type",
        F.lit(None).cast("string").alias("refers_to"),
        F.lit(None).cast("bigint").alias("refers_to_id"),
        F.col("n_bytes").alias("payload_bytes"),
        base32(F.col("digest")).alias("payload_digest"),
        (F.col("intact") & told).alias("intact"),
    )
    known = responses.select(
        F.col("record_id").alias("refers_to"),
        F.col("id").alias("refers_to_id"),
        F.col("payload_bytes").alias("_bytes"),
        F.col("payload_digest").alias("_digest"),
        F.col("intact").alias("_intact"),
    )
    same = (F.col("_bytes") == F.col("declared_bytes")) & (F.col("_digest") == F.col("declared_digest")) & F.col("_intact")
    revisits = (
        heads.filter("record_type = 'revisit'")
        .join(known, "refers_to", "left")
        .select(
            *own,
            "record_type",
            "refers_to",
            "refers_to_id",
            F.col("declared_bytes").alias("payload_bytes"),
            F.col("declared_digest").alias("payload_digest"),
            F.coalesce(same, F.lit(False)).alias("intact"),
        )
    )
    return responses.unionByName(revisits)


def archived(pages: DataFrame, **settings) -> DataFrame:
    """Write ``pages`` into the shared folder and read the records back."""
    path = Scratch(pages.sparkSession, "warc").path
    write_archive(pages, path, **settings)
    return read_records(pages.sparkSession, path)
