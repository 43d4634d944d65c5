from collections import Counter

import numpy as np
import pytest

from tradepost.llm import embedding_join


def vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    rows = [(i, b.tolist()) for i, b in enumerate(base)]
    for k in range(120):  # one large group, and pairs near the threshold
        rows.append((100 + k, (base[0] + rng.normal(size=16) * 0.12).tolist()))
    for k in range(40):
        rows.append((300 + k, (base[1 + k % 5] * rng.uniform(0.1, 9) + rng.normal(size=16) * 0.3).tolist()))
    rows += [(400 + k, base[7].tolist()) for k in range(5)] + [(410, (base[7] * 3).tolist()), (400, base[7].tolist())]
    rows += [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [1.0] * 15 + [float("inf")]), (504, [1.0] * 15 + [None])]
    rows += [(505, []), (506, base[2][:15].tolist()), (507, (base[3] * 1e-30).tolist()), (508, (base[3] * 1e30).tolist()), (None, base[4].tolist())]
    return rows


def brute(rows):
    x = np.zeros((len(rows), 16))
    usable = np.zeros(len(rows), bool)
    for i, (_, v) in enumerate(rows):
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            w = np.array(v) / np.abs(v).max()
            x[i, : len(v)], usable[i] = w / np.linalg.norm(w), True
    linked = (x @ x.T >= 0.95) & usable[:, None] & usable[None, :]
    np.fill_diagonal(linked, False)
    out = Counter()
    for i in range(len(rows)):
        reached, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(linked[todo.pop()]):
                if j not in reached:
                    reached.add(j)
                    todo.append(j)
        out[rows[i][0], int(linked[i].sum()), min((rows[j][0] for j in reached if rows[j][0] is not None), default=None)] += 1
    return out


@pytest.mark.parametrize("box", [4096, 20, 1])
def test_links_equal_brute_force(spark, monkeypatch, box):
    monkeypatch.setattr(embedding_join, "BOX_ROWS", box)
    monkeypatch.setattr(embedding_join, "DEPTH", 3)  # small boxes are then dealt out further
    rows = vectors()
    table = spark.createDataFrame([(i, v, 3, "n") for i, v in rows], "vec_id bigint, embedding array<double>, label int, node string")
    got = embedding_join.near_vectors(table.repartition(3)).collect()
    assert Counter((r["id"], r["n_links"], r["component_id"]) for r in got) == brute(rows)


def test_pairs_meet_in_the_first_block_only():
    rng = np.random.default_rng(5)
    x = embedding_join._units(rng.normal(size=(500, 12)))
    layout = embedding_join.fit(x, 500, 0.95, blocks=3)
    assert sum(layout.budgets) == pytest.approx(0.1)


def test_empty_tables_and_no_usable_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert embedding_join.near_vectors(spark.createDataFrame([], schema)).collect() == []
    got = embedding_join.near_vectors(spark.createDataFrame([(1, None), (2, [])], schema)).collect()
    assert sorted((r["id"], r["n_links"], r["component_id"]) for r in got) == [(1, 0, 1), (2, 0, 2)]
