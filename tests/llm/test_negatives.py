import numpy as np
import pandas as pd
import pytest

from cellweave.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, v string, q int, cell long"


def table(seed, n=400, d=9, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, d))
    x = (centres[rng.integers(labels, size=n)] + 0.4 * rng.normal(size=(n, d))).astype(np.float32)
    x[50:120] = x[50]  # many equal vectors, so ties
    rows = [(i, [float(c) for c in x[i]], int(rng.integers(labels)), "x", 1, 2) for i in range(n)]
    rows += [(n, None, 1, "x", 1, 2), (n + 1, [1.0] * d, None, "x", 1, 2), (None, [1.0] * d, 2, "x", 1, 2), (n + 2, [None] + [1.0] * (d - 1), 2, "x", 1, 2)]
    rows += [(n + 3, [float("nan")] + [1.0] * (d - 1), 2, "x", 1, 2), (n + 4, [float("inf")] * d, 2, "x", 1, 2), (n + 5, [], 2, "x", 1, 2), (n + 6, [0.0] * d, 2, "x", 1, 2)]
    return rows + rows[:5] + [(1000 + 10 * i, [1.0, float(i), -0.5], i % 3, "x", 1, 2) for i in range(40)]


def answer(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("setting", [{}, {"block": 37, "anchor_block": 3, "words": 5}])
def test_equals_brute_force(spark, setting):
    rows = table(3)
    want = negatives.brute_force(pd.DataFrame([r[:3] for r in rows], columns=["vec_id", "embedding", "label"]), anchor_every=10)
    got = answer(negatives.mine(spark.createDataFrame(rows, SCHEMA), anchor_every=10, **setting))
    assert got == want and len(got) > 300


def test_empty_and_single(spark):
    frame = spark.createDataFrame(table(1), SCHEMA)
    assert answer(negatives.mine(frame.limit(0))) == []
    assert answer(negatives.mine(frame.where("vec_id = 100"))) == []


def test_bounds_hold_and_order_visits():
    rng = np.random.default_rng(7)
    v = np.floor(256 * (rng.normal(size=(40, 16))[rng.integers(40, size=3000)] + 0.05 * rng.normal(size=(3000, 16)))).astype(np.int64)
    halves = negatives.Halves.fit(v[:1000].astype(float), 16)
    cells = negatives.Cells(halves, np.arange(3000), rng.integers(5, size=3000), v)
    for q in v[:20]:
        upper, lower = cells.half_bounds(q)
        scores = cells.v @ q
        for i in range(len(cells.words[0])):
            for j in range(len(cells.words[1])):
                c = i * len(cells.words[1]) + j
                own = scores[cells.begins[c] : cells.ends[c]]
                assert not len(own) or own.max() <= upper[0][i] + upper[1][j] and own.min() >= lower[0][i] + lower[1][j]
        seen = []

        class All:
            need, most = -np.inf, np.inf

            def add(self, s, ids, labels):
                seen.extend(ids.tolist())

        assert cells.visit(q, All()) == 3000 and sorted(seen) == list(range(3000))  # every row once


def test_certified_windows_leave_cells_out():
    rng = np.random.default_rng(8)
    v = np.floor(256 * (rng.normal(size=(30, 16))[rng.integers(30, size=4000)] + 0.02 * rng.normal(size=(4000, 16)))).astype(np.int64)
    labels = rng.integers(5, size=4000)
    cells = negatives.Cells(negatives.Halves.fit(v[:1000].astype(float), 32), np.arange(4000), labels, v)
    scored = 0
    for a in range(20):
        search = negatives._Positives(a, labels[a], 5)
        scored += cells.visit(v[a], search, 64)
        s = v @ v[a]
        own = np.flatnonzero((labels == labels[a]) & (np.arange(4000) != a))
        assert search.ids.tolist() == own[np.lexsort((own, -s[own]))][:5].tolist()
    assert scored < 20 * 4000 / 3


def test_large_components_are_exact_or_refused():
    x = np.array([[1 << 30, 3], [-(1 << 30), 5]])
    assert negatives.products(x, np.array([1 << 29, 1])).tolist() == [(1 << 59) + 3, -(1 << 59) + 5]
    with pytest.raises(ArithmeticError):
        negatives.products(x, np.array([1 << 40, 1]))
