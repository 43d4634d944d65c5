from collections import Counter

import pytest
from pyspark.sql import functions as F

from tradepost.llm import exact_dedup, near_join, secret_scan
from tradepost.llm.scratch import Scratch

from .conftest import words

SPLIT = "spark.sql.files.maxPartitionBytes"
HEX = "0123456789abcdef" * 3


@pytest.fixture
def regrouped(spark, make_docs, folder, monkeypatch):
    """Stored documents in many files that every job groups otherwise, as it happens when cores come or go between jobs."""
    base = [words(40, i) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(20 + i, t) for i, t in enumerate(base[:6])]
    rows += [(40 + i, t + " more") for i, t in enumerate(base[:4])] + [(60 + i, f"{words(5, i)} token={HEX} {i}") for i in range(5)]
    make_docs(rows).repartition(9, F.rand(3)).write.parquet(f"{folder}/docs")
    before, cut, n = spark.conf.get(SPLIT), Scratch.cut, [0]

    def other_split():
        n[0] += 1
        spark.conf.set(SPLIT, ("64k", "128m")[n[0] % 2])

    def cut_and_split(self, df, *rest):
        out = cut(self, df, *rest)
        other_split()
        return out

    monkeypatch.setattr(Scratch, "cut", cut_and_split)
    other_split()
    yield spark.read.parquet(f"{folder}/docs"), rows, other_split
    spark.conf.set(SPLIT, before)


def collected(df, other_split):
    first = df.collect()
    other_split()
    again = df.select("*").collect()
    assert Counter(first) == Counter(again)
    return first


def test_near_copies_are_found_again(regrouped):
    docs, rows, other_split = regrouped
    got = {r["id"]: r for r in collected(near_join.near_duplicates(docs), other_split)}
    assert set(got) == {i for i, _ in rows}
    assert all(got[i]["class_id"] == i % 20 and got[i]["n_links"] == (i % 20 < 6) + (i % 20 < 4) for i in got if i < 60)
    stay = collected(near_join.one_of_each(docs), other_split)
    assert sorted(r["doc_id"] for r in stay) == [*range(12), *range(60, 65)]


def test_copies_are_found_again(regrouped):
    docs, rows, other_split = regrouped
    stay = collected(exact_dedup.without_copies(docs), other_split)
    last = {t: i for i, t in rows}
    assert sorted((r["doc_id"], r["text"]) for r in stay) == sorted((i, t) for t, i in last.items())


def test_spans_cut_the_text_they_were_found_in(regrouped):
    docs, rows, other_split = regrouped
    got = collected(secret_scan.redact(docs), other_split)
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted((i, t.replace(f"token={HEX}", "[secret]")) for i, t in rows)
