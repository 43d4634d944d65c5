import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradepost.llm import exact_dedup, sharding


def shards(docs, n=16):
    return sharding.assign_shards(docs, "doc_id", sharding.byte_size(docs["text"]), n, {"lang": docs["lang"]}).collect()


def test_shards_are_contiguous_balanced_and_gapless(odd_docs, odd_rows):
    got = shards(odd_docs, 3)
    assert len(got) == len(odd_rows)
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in odd_rows)
    assert Counter(r["size"] for r in got) == Counter(len((t or "").encode()) + 1 for _, t in odd_rows)
    for shard in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    line = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in line]
    assert ids == sorted(ids)  # missing ids first
    total, before = sum(r["size"] for r in got), 0
    for r in line:
        assert r["shard"] == min(2, (2 * before + r["size"]) * 3 // (2 * total))
        before += r["size"]


def test_shards_over_many_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 7)
    docs = spark.range(0, 1000, 1, 5).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.lit("l").alias("lang"))
    got = shards(docs)
    sizes = Counter(r["shard"] for r in got)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(r["slot"] == r["doc_id"] - min(x["doc_id"] for x in got if x["shard"] == r["shard"]) for r in got)


def test_no_rows_no_shards(no_docs):
    assert shards(no_docs) == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 300, 5000])
def test_perfect_hash_uses_every_slot_once(n):
    words = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint64).reshape(-1, 4)
    seeds, slots = exact_dedup.perfect_hash(words)
    assert sorted(slots) == list(range(n))
    held = {"seeds": seeds, "digests": words[np.argsort(slots)]}
    found, member = exact_dedup._find(held, words)
    assert member.all() and (found == slots).all()
    other = np.frombuffer(hashlib.sha256(b"other").digest(), np.uint64).reshape(-1, 4)
    assert not exact_dedup._find(held, other)[1].any()


def check_dedup(got, rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert Counter(r["id"] for r in got) == Counter(i for i, _ in rows)
    seen = Counter()
    for r in got:
        text = next(t or "" for t in groups if hashlib.sha256(t.encode()).digest() == bytes(r["digest"]))
        ids = groups[text]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        if r["row"] == r["keep_row"]:
            seen[text] += 1
            assert r["id"] == r["keep_id"]
    assert seen == Counter(list(groups))  # one row of each group


def test_exact_copies(odd_docs, odd_rows):
    check_dedup(exact_dedup.exact_dedup(odd_docs).collect(), odd_rows)


@pytest.mark.parametrize("middle", [-1, 3, 21, 1000])
def test_any_share_of_history(odd_docs, odd_rows, middle):
    slim = odd_docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), exact_dedup.text_digest(odd_docs["text"]).alias("digest"))
    got = exact_dedup.decide(slim, F.coalesce(F.col("id") <= middle, F.lit(False)), buckets=3).collect()
    check_dedup(got, odd_rows)


def test_rows_that_stay(odd_docs, odd_rows):
    got = exact_dedup.without_copies(odd_docs)
    assert got.columns == odd_docs.columns
    assert sorted((r["text"] or "") for r in got.collect()) == sorted({t or "" for _, t in odd_rows})


def test_no_rows_no_decisions(no_docs):
    assert exact_dedup.exact_dedup(no_docs).collect() == []
    assert exact_dedup.without_copies(no_docs).collect() == []


@pytest.mark.parametrize("ids", [[None] * 80, [-(10**15), *range(79)], [*range(79), 10**15]])
def test_buckets_grow_with_all_rows(make_docs, monkeypatch, ids):
    rows = [(i, f"text {n // 2}") for n, i in enumerate(ids)]
    asked, distinct = [], exact_dedup.distinct_digests

    def spy(some, buckets):
        asked.append((some.count(), buckets))
        return distinct(some, buckets)

    monkeypatch.setattr(exact_dedup, "BUCKET", 4)
    monkeypatch.setattr(exact_dedup, "distinct_digests", spy)
    check_dedup(exact_dedup.exact_dedup(make_docs(rows)).collect(), rows)
    (old, buckets), (new, same) = asked
    assert buckets == same and old + new == len(rows) and max(old, new) <= 4 * buckets
    assert abs(old - new) <= 8 or ids[0] is None  # one far id does not move the middle
