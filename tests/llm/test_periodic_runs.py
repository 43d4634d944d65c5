import hashlib
import random
import re
import zlib

import pytest

from tradepost.llm import periodic_runs
from tradepost.llm.queries import QUERIES, planted

from .conftest import words

SF = "/root/testdata/sf0.001"


def brute(w):
    """All runs by trying every period and, for each stretch, every shorter one."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            if length >= max(12, 2 * q):
                stretch = w[start : start + length]
                if next(p for p in range(1, q + 1) if stretch[:-p] == stretch[p:]) == q:
                    out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repeating(rng):
    kinds = rng.choice([1, 2, 2, 3, 5, 40])
    w = [f"w{rng.randrange(kinds)}" for _ in range(rng.randint(0, 150))]
    for _ in range(rng.randint(0, 4)):
        if len(w) > 8:
            a = rng.randrange(len(w))
            p = rng.randint(1, (len(w) - a) // 2 + 1)
            for i in range(a + p, min(len(w), a + p * rng.randint(2, 5) + rng.randint(0, 3))):
                w[i] = w[i - p]
    if rng.random() < 0.3:  # two stretches of one short period that meet out of step
        u = [f"w{rng.randrange(2)}" for _ in range(rng.randint(1, 4))] * rng.randint(1, 15)
        w = u + u[: rng.randint(0, len(u))] + u + w[:5] + u
    return w


def test_runs_equal_brute_force():
    rng = random.Random(11)
    seen = 0
    for _ in range(150):
        texts = [repeating(rng) for _ in range(rng.randint(1, 5))]
        n, runs, left = periodic_runs._some([" ".join(w).encode() for w in texts])
        for w, count, own, kept in zip(texts, n, runs, left):
            want = brute(w)
            seen += len(want)
            assert count == len(w) and [tuple(r) for r in own.tolist()] == want and kept == collapsed(w, want)
    assert seen > 500


@pytest.mark.parametrize("period", [1, 7, 8, 9, 63, 64, 65, 1000, 5000])
def test_long_periods_of_exactly_two(period):
    unit = [f"{period}-{i}" for i in range(period)]
    w = ["a", "b"] + unit * 2 + ["c"] if period >= 6 else ["a"] + unit * 12
    _, runs, _ = periodic_runs._some([" ".join(w).encode()])
    assert runs[0].tolist() == ([[2, 2 * period, period]] if period >= 6 else [[1, 12, 1]])


def test_one_word_and_two_out_of_step_stretches_stay_small():
    _, runs, left = periodic_runs._some([b"a " * 300_000])
    assert runs[0].tolist() == [[0, 300_000, 1]] and left == ["a"]
    half = [b"a", b"b"] * 2000 + [b"a"]
    _, runs, _ = periodic_runs._some([b" ".join(half + half)])
    # one run per odd period that the meeting point has room for, and the stretches themselves
    assert len(runs[0]) == 2 + len([q for q in range(1, 4002, 2) if 2 * q >= 12])


def test_odd_rows(odd_docs, odd_rows):
    got = sorted(odd_collect(periodic_runs.periodic_runs(odd_docs)), key=str)
    want = []
    for i, t in odd_rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute(w) if len(w) < 2000 else []
        want.append((i, len(w), runs, collapsed(w, runs)))
    assert got == sorted(want, key=str)


def odd_collect(df):
    return [(r["id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in df.collect()]


def test_blanks_are_ascii_and_rows_repeat(make_docs):
    text = "\x1c   \x85 \xa0 " * 6
    got = odd_collect(periodic_runs.periodic_runs(make_docs([(1, text), (1, text), (2, "x\x0by\x0cz\r\n" * 5)])))
    assert sorted(got) == [(1, 24, [(0, 24, 4)], "\x1c   \x85 \xa0")] * 2 + [(2, 15, [(0, 15, 3)], "x y z")]


def test_no_rows(no_docs):
    assert periodic_runs.periodic_runs(no_docs).collect() == []


def replanted(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
    return w


def test_planted_texts(make_docs):
    rows = [(i, words(1 + i % 37, i)) for i in range(300)] + [(i, "") for i in range(400, 440)] + [(None, "a b"), (7, None)]
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], (r["text"] or "").split()) for r in planted(make_docs(rows)).collect())
    assert got == sorted((-1 if i is None else i, replanted(i, t)) for i, t in rows)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for i, text in docs:
        w = replanted(i, text)
        if len(w) > 1500:
            continue  # the check by every period is cubic
        runs = brute(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want[i] = (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2]) + tuple(
            hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(w, runs))
        )
    got = QUERIES["op11_periodic_runs"](spark, SF).collect()
    assert len(got) == len(docs) and {r["doc_id"]: tuple(r)[1:] for r in got if r["doc_id"] in want} == want
    assert sum(v[0] > 0 for v in want.values()) > 10
