import base64
import glob
import gzip
import hashlib
import random
from collections import Counter, defaultdict

import pytest

from tradepost.llm import warc
from tradepost.llm.queries import QUERIES
from tradepost.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id bigint, url string, html string, row long, nth int, bytes string, digest int, size string, record int"


@pytest.fixture
def make_pages(spark):
    def make(rows):
        return spark.createDataFrame([(*r, 3, 4, "x", 5, "y", 6) for r in rows], SCHEMA).repartition(3, "page_id")

    return make


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plain(rows, least=0):
    """What must come back, by one pass over a dictionary of payloads."""
    groups, out = defaultdict(list), []
    for page, _, html in rows:
        groups[(html or "").encode()].append(page)
    for payload, pages in groups.items():
        first = min(pages, key=lambda p: (p is None, p or 0))
        own = [len(payload), digest(payload)]
        seen = False
        for page in pages:
            if len(payload) < least or page == first and not seen:
                out.append((page, *own, "response", None))
                seen = seen or page == first
            else:
                out.append((page, *own, "revisit", first))
    return Counter(out)


def collected(df):
    return Counter((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to_id"]) for r in df.collect())


def odd_pages():
    rng = random.Random(13)
    rows = [(i, f"https://a.example/{i}", "".join(rng.choices("<p>ab \r\né🙂", k=rng.randint(0, 400)))) for i in range(40)]
    rows += [(100 + i, None, "same" * 50) for i in range(30)] + [(50, "u", "same" * 50)] * 3
    rows += [(200, "", ""), (201, "x y\r\nWARC-Type: evil", None), (202, "ü/日本", ""), (None, "n", "same" * 50), (None, "n", None), (None, "n", "alone")]
    rows += [(300, "big", "<html>" + "0123456789" * 50_000), (299, "big2", "<html>" + "0123456789" * 50_000), (301, "z", "\r\n\r\n\r\n\r\n"), (302, "z", "WARC/1.1\r\n\r\n")]
    rows += [(303, "s", warc.SEPARATOR.decode("latin-1") * 3), (-7, "neg", "rare")]
    return rows


@pytest.mark.parametrize("chunk,least", [(1 << 20, 0), (64, 0), (1, 201), (1000, 10)])
def test_records_come_back(make_pages, chunk, least):
    rows = [r for r in odd_pages() if chunk > 1 or len(r[2] or "") < 500]
    got = warc.archived(make_pages(rows), chunk=chunk, least=least)
    assert collected(got) == plain(rows, least) and got.filter("not intact").isEmpty()


def records_of(data: bytes):
    """Records of an archive read from beginning to end, by the lengths that they state."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode().split("\r\n")
        assert head[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in head[1:])
        block = data[end + 4 : end + 4 + int(fields["Content-Length"])]
        at = end + 4 + len(block)
        assert data[at : at + 4] == b"\r\n\r\n"
        at += 4
        http, payload = block.split(b"\r\n\r\n", 1)
        out.append((fields, http, payload))
    return out


@pytest.mark.parametrize("chunk", [1 << 20, 100])
def test_files_are_plain_archives(make_pages, spark, chunk):
    rows, folder = odd_pages(), Scratch(spark, "test").path
    warc.write_archive(make_pages(rows), folder, chunk=chunk, date="2024-01-02T03:04:05Z")
    records = [r for f in glob.glob(f"{folder}/part-*") for r in records_of(gzip.open(f).read())]
    assert len(records) == len(rows) == len({f["WARC-Record-ID"] for f, *_ in records})
    by_id = {f["WARC-Record-ID"]: payload for f, _, payload in records}
    got = Counter()
    for fields, _, payload in records:
        revisit = fields["WARC-Type"] == "revisit"
        assert fields["WARC-Date"] == "2024-01-02T03:04:05Z" and "\n" not in fields["WARC-Target-URI"] and fields["WARC-Target-URI"].isascii()
        assert not (revisit and payload) and revisit == ("WARC-Refers-To" in fields) == (fields.get("WARC-Profile") == warc.PROFILE)
        whole = by_id[fields["WARC-Refers-To"]] if revisit else payload
        assert fields["WARC-Payload-Digest"] == "sha1:" + digest(whole)
        got[int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None, whole] += 1
    assert got == Counter((p, (h or "").encode()) for p, _, h in rows)


def test_chunk_table_carries_digests(make_pages, spark):
    folder = Scratch(spark, "test").path
    html = "0123456789" * 1000
    warc.write_archive(make_pages([(1, "u", html), (2, "v", "short")]), folder, chunk=300)
    chunks = sorted((r for r in warc.read_chunks(spark, folder).collect() if r["n_bytes"] == 300 or r["nth"]), key=lambda r: r["nth"])
    assert [r["nth"] for r in chunks] == list(range(34)) and [r["last"] for r in chunks] == [False] * 33 + [True]
    carried = hashlib.sha1()
    for r in chunks:
        assert len(r["payload"]) <= 300
        carried.update(r["payload"])
        assert carried.digest() == r["running"]
    assert b"".join(r["payload"] for r in chunks) == html.encode()


def test_damage_is_noticed(make_pages, spark):
    folder = Scratch(spark, "test").path
    warc.write_archive(make_pages([(1, "u", "0123456789" * 100)]), folder, chunk=300)
    chunks = warc.read_chunks(spark, folder).collect()
    chunks.sort(key=lambda r: r["nth"])
    import pyarrow as pa

    rows = [{"record": 1, "nth": r["nth"], "last": r["last"], "running": r["running"], "payload": r["payload"]} for r in chunks]
    assert next(warc._digest(iter([pa.RecordBatch.from_pylist(rows)]))).to_pylist()[0]["intact"]
    rows[1]["payload"] = b"x" + rows[1]["payload"][1:]
    assert not next(warc._digest(iter([pa.RecordBatch.from_pylist(rows)]))).to_pylist()[0]["intact"]
    line = warc.member(b"data", warc.extra_field(1, 0, True, b"d" * 20))
    assert warc.opened(line) == (1, 0, True, b"d" * 20, b"data") and gzip.decompress(line) == b"data"
    with pytest.raises(Exception):
        warc.opened(line[:-8] + b"\0" * 8)


def test_a_payload_like_the_separator():
    rng = random.Random(1)
    noise = bytes(rng.randrange(256) for _ in range(5000))  # does not compress, so it may be stored as it is
    out = warc.member(noise + warc.SEPARATOR + noise)
    assert warc.SEPARATOR not in out and gzip.decompress(out) == noise + warc.SEPARATOR + noise
    assert gzip.decompress(warc.SEPARATOR) == b""


def test_a_small_memory_of_payloads(make_pages, monkeypatch):
    monkeypatch.setattr(warc, "REMEMBERED", 2)
    rows = [(i, "u", f"page {i % 7}") for i in range(60, 0, -1)]
    assert collected(warc.archived(make_pages(rows))) == plain(rows)


def test_no_rows(make_pages):
    assert warc.archived(make_pages([])).collect() == []


def test_query_equals_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    got = QUERIES["op13_warc"](spark, SF).collect()
    assert Counter(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got) == plain(rows)
