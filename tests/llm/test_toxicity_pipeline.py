import random
import re
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tradepost.llm import toxicity
from tradepost.llm.queries import QUERIES, toxicity_model

from .conftest import words

SF = "/root/testdata/sf0.01"


def labelled():
    rng, rows = random.Random(8), []
    for i in range(600):
        text = words(rng.randint(5, 80), i).split()
        toxic = i % 6 == 0
        for _ in range(rng.randint(1, 4) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["vilify", "wretch", "qazen", "qazos", "qazir"]))
        if i % 60 == 1:
            text.insert(0, "poor wretch")
        rows.append((i, " ".join(text), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(spark, make_docs):
    rows = labelled()
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    return toxicity.fit(make_docs([(i, t) for i, t, _ in rows]), labels)


def test_lexicon_beginnings_and_exceptions(model):
    entries = dict(model.lexicon)
    assert {" viiify ", " qaz", " wretch "} <= set(entries)  # l is folded to i; a word, what several words begin with, a word
    assert " poor wretch " in model.exceptions


def test_scores(spark, make_docs, model):
    clean = words(30, 77)
    texts = ["", None, clean, clean + " vilify you", clean + " VÎLlFY", clean + " v1l1fy", clean + " wr3tch", clean + " wгetch".replace("г", "r").replace("e", "е"),
             clean + " poor wretch", clean + " qazimodo", "2023 1 0", clean + " " + words(20_000, 3)]
    got = {r["doc_id"]: r["s"] for r in make_docs(list(enumerate(texts))).select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    for i in (3, 4, 5, 6, 7, 9):
        assert got[i] >= 0.7, texts[i][-12:]
    for i in (0, 1, 2, 8, 10, 11):
        assert got[i] < 0.5


def test_folding():
    assert toxicity.folded("1D10T b@d l00k 4 2023, É​té") == " idiot bad iook ete "
    assert toxicity.folded(None) == "  "
    assert toxicity.folded("раура") == " paypa "


def test_fit_without_labels(spark, make_docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    docs = make_docs([(1, "a b c"), (2, None)])
    empty = toxicity.fit(docs, none)
    assert empty.lexicon == () and docs.select(toxicity.score(docs["text"], empty)).count() == 2
    assert toxicity.without_toxic(no_docs, empty).collect() == []


def test_held_out_labels_and_quality(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = QUERIES["op8_toxicity"](spark, folder).join(labels, "doc_id").toPandas()
    held = scored[scored["held_out"]]
    positive, negative = held[held["toxic"] == 1]["score"], held[held["toxic"] == 0]["score"]
    wins = sum((p > negative).mean() + 0.5 * (p == negative).mean() for p in positive) / len(positive)
    assert wins > 0.95
    assert (negative >= toxicity.CUT).mean() < 0.005 and (positive >= toxicity.CUT).mean() > 0.85
    changed = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    held_out = toxicity.held_out(F.col("doc_id"))
    one = toxicity.fit(docs, labels.filter(~held_out))
    two = toxicity.fit(docs, changed.filter(~held_out))
    assert one == two == toxicity_model(spark, folder, docs)


def test_pipeline(spark):
    sys.path.insert(0, "/root/repo")
    import corpus_pipeline as pipeline

    from tradepost.llm.scratch import Scratch

    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram jaccard join", "secret scans", "best-fit packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    written, tables = Scratch(spark, "test"), [docs]
    for _, stage in pipeline.STAGES:
        tables.append(written.cut(stage(spark, tables[-1], SF)))
    assert all(t.columns == docs.columns for t in tables[:-1])
    rows = [{r["doc_id"]: r["text"] for r in t.collect()} for t in tables[:-1]]
    clean = tables[1].select(toxicity.score(F.col("text"), toxicity_model(spark, SF, docs)).alias("s"))
    assert clean.filter(f"s >= {toxicity.CUT}").count() == 0 and len(rows[1]) < len(rows[0])
    largest = {}
    for i, t in rows[1].items():
        largest[t] = max(i, largest.get(t, -1))
    assert rows[2] == {i: t for t, i in largest.items()}
    assert set(rows[3]) == first_of_each(rows[2])
    assert set(rows[4]) == set(rows[3])
    for i, t in rows[4].items():
        if "[secret]" not in t:
            assert t == rows[3][i]
        assert not re.search("AKIA[A-Z0-9]{16}|[0-9a-f]{24}", t)
    lengths = Counter()
    for r in tables[-1].collect():
        lengths[r["doc_id"]] += r["length"]
    assert set(lengths) == set(rows[4])


def first_of_each(texts):
    def grams(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: grams(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] | sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in texts if find(i) == i}
