import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row long, id string, shard int, score double, node string, spans string"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """Documents (doc_id, text) with further columns whose names operators use inside."""
        full = [(i, t, "en", "s", None if t is None else len(t), 7, "x", -1, 9.0, "n", "z") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3, "doc_id")

    return make


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Missing ids and texts, empty and blank texts, repeated rows, copies, a very long text."""
    base = [words(60, i) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0]), (21, base[0]), (22, ""), (23, None), (24, " \n"), (None, base[1]), (None, None)]
    rows += [(30, words(20_000, 99)), (31, "é" * 5000), (32, base[2].replace(" ", "  ", 3) + " x"), (33, "\U0001f642 日本語 a.b")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(make_docs, odd_rows):
    return make_docs(odd_rows)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
