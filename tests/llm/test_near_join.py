import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tradepost.llm import near_join
from tradepost.llm.near_join import Settings

from .conftest import words


def grams(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    links, root = Counter(), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if sets[i] == sets[j] or union and len(sets[i] & sets[j]) / union >= 0.8:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(i)
    out = Counter()
    for members in classes.values():
        smallest = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        for i in members:
            out[rows[i][0], smallest, links[i]] += 1
    return out, len(classes)


def near_rows():
    rng, rows, n = random.Random(1), [], 0
    for size, copies in ((80, 40), (200, 25), (30, 6), (6, 3), (4, 3)):
        base = words(size, 1000 + size).split()
        for _ in range(copies):
            changed = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                changed[rng.randrange(size)] = words(1, rng.random())
            rows.append((n, " ".join(changed)))
            n += 1
    return rows + [(n + i, words(50, 5000 + i)) for i in range(20)]


@pytest.mark.parametrize("settings", [Settings(), Settings(block=7, remembered=50)])
def test_links_and_classes_equal_brute_force(make_docs, odd_rows, settings):
    rows = near_rows() + [(None if i is None else 1000 + i, t) for i, t in odd_rows]
    got = near_join.near_duplicates(make_docs(rows), settings=settings).collect()
    expected, classes = brute(rows)
    assert Counter((r["id"], r["class_id"], r["n_links"]) for r in got) == expected
    assert sum(r["kept"] for r in got) == classes


def test_many_pairs_are_counted_alike():
    sketcher = near_join.Sketcher(Settings())
    rows = [(i, 1, t) for i, (_, t) in enumerate(near_rows()) if t]
    a, b = near_join._Block(sketcher, rows[:60]), near_join._Block(sketcher, rows[30:])
    left, right = (x.reshape(-1) for x in np.meshgrid(np.arange(len(a.node)), np.arange(len(b.node)), indexing="ij"))
    many = near_join._shared(a, b, left, right, width=64)
    few = [len(set(a.grams[i]) & set(b.grams[j])) for i, j in zip(left, right)]
    assert many.tolist() == few


def test_pruning_keeps_pairs_at_the_threshold():
    steps = near_join.least_agreements(Settings())
    assert steps[-1][0] == 216 and all(least < 0.8 * n for n, least in steps)
    assert steps[-1][1] > 100  # and drops pairs that agree on half the values


def test_one_of_each_keeps_columns(make_docs):
    docs = make_docs(near_rows())
    got = near_join.one_of_each(docs)
    assert got.columns == docs.columns
    assert got.count() == brute(near_rows())[1]


def test_no_rows_no_links(no_docs):
    assert near_join.near_duplicates(no_docs).collect() == []


def test_contracted_edges_connect_the_same(spark):
    rng = random.Random(4)
    lows = list(range(40))
    edges = [(a, rng.choice(lows)) for a in range(40, 2000) for _ in range(8)] + [(a, a - 1) for a in range(3001, 3030)]
    edges += [(a, b) for a in range(1, 40) for b in rng.sample(lows[:a], 1)]
    few = [tuple(r) for r in near_join.contracted(spark.createDataFrame(edges, "a bigint, b bigint")).collect()]

    def groups(pairs):
        root = {x: x for e in pairs for x in e}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {x: find(x) for x in root}

    assert groups(few) == groups(edges)
    assert len(few) < 1.6 * 2000 < len(set(edges)) / 4


def test_each_table_is_stored_once(make_docs, odd_rows, monkeypatch):
    stored, cut = [], near_join.Scratch.cut
    monkeypatch.setattr(near_join.Scratch, "cut", lambda self, df, *a: stored.append(tuple(df.columns)) or cut(self, df, *a))
    assert near_join.near_duplicates(make_docs(odd_rows)).count() == len(odd_rows)
    # Groups of linked nodes are stored where they are found, sums of links with the nodes.
    assert not {("node", "area"), ("node", "class"), ("node", "links")} & set(stored) and len(stored) == 7
