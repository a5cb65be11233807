import random

import numpy as np
import pytest
from helpers import SCHEMA, corpus

from cellweave.llm import ranked


def frames(spark, documents, items):
    d = spark.createDataFrame([(i, t, "en", "s", 0, 0.5, "k", 1) for i, t in documents], SCHEMA)
    return d, spark.createDataFrame(items, "item_id string, text string")


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("setting", [{}, {"block_postings": 60, "leaf": 4, "width": 2}, {"leaf": 0, "width": 1}, {"item_terms": 40}])
def test_equals_brute_force(spark, seed, setting):
    documents = [(r[0], r[1]) for r in corpus(seed)]
    rng = random.Random(seed)
    words = " ".join(t or "" for _, t in documents).split()
    items = [(f"i{k}", " ".join(rng.choices(words, k=rng.randint(1, 30)))) for k in range(8)]
    items += [("rep", "same same SAME one"), ("none", None), ("unknown", "zzz"), ("signs", "!? -- "), ("é", "É é one"), ("i0", items[1][1])]
    got = rows(ranked.search(*frames(spark, documents, items), **setting))
    assert got == sorted(ranked.brute_force(documents, items), key=str) and len(got) > 100


def test_empty_tables(spark):
    d, i = frames(spark, [(1, "a b"), (2, None)], [("x", "a")])
    assert rows(ranked.search(d.limit(0), i)) == [] and rows(ranked.search(d, i.limit(0))) == []
    assert [r[:3] for r in rows(ranked.search(d, i))] == [("x", 1, 1)]


def test_many_copies_and_a_long_document(spark):
    documents = [(k, "alpha beta gamma") for k in range(300, 0, -1)] + [(0, "alpha " * 30_000 + "delta")] + [(1000 + k, f"w{k} beta") for k in range(50)]
    items = [("a", "alpha beta"), ("b", "delta w3")]
    assert rows(ranked.search(*frames(spark, documents, items), block_postings=100, leaf=8)) == sorted(ranked.brute_force(documents, items), key=str)


def test_range_maximum_tables():
    rng = np.random.default_rng(5)
    n, size = 200, 12
    terms = [np.sort(rng.choice(size, rng.integers(1, size), replace=False)) for _ in range(n)]
    tf = [rng.integers(1, 9, len(t)) for t in terms]
    block = ranked.Block(np.arange(n), rng.integers(75, 200, n), np.array([len(t) for t in terms]), np.concatenate(terms), np.concatenate(tf), rng.integers(0, 50, size))
    for _ in range(300):
        t = rng.integers(size)
        lo, hi = np.searchsorted(block.key, [t * n, (t + 1) * n])
        a, b = sorted(rng.integers(lo, hi + 1, 2).tolist())
        at, value = block.greatest(np.array([[a]]), np.array([[b]]))
        assert value[0, 0] == (block.impact[a:b].max() if b > a else 0)
        assert b == a or block.impact[at[0, 0]] == value[0, 0] and a <= at[0, 0] < b


def test_intervals_are_left_out_by_their_bounds(spark):
    """With one document far ahead of all others, most of a block is never scored."""
    rng = np.random.default_rng(1)
    n = 4000
    sizes = np.full(n, 3)
    terms = np.concatenate([np.sort(rng.choice(40, 3, replace=False)) for _ in range(n)])
    tf = np.where(np.arange(3 * n) < 60, 50, 1)
    block = ranked.Block(np.arange(n), np.where(np.arange(n) < 20, 75, 5_000), sizes, terms, tf, np.full(40, 1000))
    scored = []

    class Counting(ranked.Best):
        def add(self, scores, docs):
            scored.append(len(docs))
            super().add(scores, docs)

    top = Counting(3)
    block.best(np.arange(40), np.ones(40, np.int64), top, 16, 4)
    assert set(top.docs) <= set(range(20)) and sum(scored) < n / 4


def test_a_word_with_the_hash_of_a_term_is_told_by_its_bytes():
    v = ranked.Vocabulary([b"abc", b"de"])
    v.hashes = v.hashes.copy()
    data = np.frombuffer(b"abc xyz DE d", np.uint8)
    starts, stops, _ = ranked.W.words(data, np.array([0, len(data)]), ranked.W.ALNUM_LOWER)
    which, term = v.find(data, starts, stops)
    assert which.tolist() == [0, 2] and term.tolist() == [0, 1]
    forged = ranked.W.word_hashes(data, starts, stops, ranked.W.ALNUM_LOWER, v.seed)[1]
    v.hashes[np.flatnonzero(v.order == 0)[0]] = forged  # xyz now has the hash of abc
    order = np.argsort(v.hashes)
    v.hashes, v.order = v.hashes[order], v.order[order]
    assert v.find(data, starts, stops)[0].tolist() == [2]
