import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, corpus, fold, space_words

from cellweave.llm import decontaminate, jaccard, substrings, toxicity
from cellweave.llm.components import components


def brute_components(rows):
    sets = []
    for _, text, *_ in rows:
        w = space_words(fold(text))
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect())
    assert got == Counter(brute_components(rows))


def test_jaccard_large_regions_recurse(spark, monkeypatch):
    """With regions of two, nearly every region is large and goes through pivots and windows."""
    monkeypatch.setattr(jaccard, "_SMALL", 2)
    rows = corpus(5, n=40, hot=24)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect())
    assert got == Counter(brute_components(rows))


def test_jaccard_representatives(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, SCHEMA)
    out = jaccard.representatives(df)
    assert out.columns == df.columns
    groups = {}
    for (i, n, c), r in zip(brute_components(rows), rows, strict=True):
        groups.setdefault(c if n and i is not None else ("own", i, r[1]), []).append(i)
    kept = Counter(r.doc_id for r in out.collect())
    for c, ids in groups.items():
        if not isinstance(c, tuple):
            assert sum(kept[i] for i in set(ids)) == 1, (c, ids)


@pytest.mark.parametrize("tile", [128, 3])
def test_jaccard_links_are_whole(spark, tile, monkeypatch):
    """Every pair of different sets at the threshold is a link, also in a large group joined by chains."""
    monkeypatch.setattr(jaccard, "_TILE", tile, raising=False)
    rows = corpus(6, n=40, hot=40)
    # a chain of texts of growing length, each linked with some of the others
    chain = [f"c{i}" for i in range(90)]
    rows += [(1000 + i, " ".join(chain[: 20 + 2 * i]), "en", "s", 1, 0.5, "k", 1) for i in range(35)]
    sets = []
    for _, text, *_ in rows:
        w = space_words(fold(text))
        k = min(5, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    classes = set(sets) - {frozenset()}
    degree = {s: sum(s != t and 100 * len(s & t) >= 75 * len(s | t) for t in classes) for s in classes}
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = Counter((r.doc_id, r.n_links) for r in jaccard.join(df).collect())
    assert got == Counter((r[0], degree.get(s, 0)) for r, s in zip(rows, sets, strict=True))
    if tile == 3:
        links = [(r.x, r.y) for r in jaccard.linked(df)[1].collect()]
        assert len(links) == len(set(links)) == sum(degree.values()) // 2 and all(x < y for x, y in links)


@pytest.mark.parametrize("parting", [True, False])
def test_jaccard_cells_are_parted(spark, parting, monkeypatch):
    """Cells over the limit go through Voronoi regions (or tiles) and give every link once."""
    monkeypatch.setattr(jaccard, "_SMALL", 2)
    monkeypatch.setattr(jaccard, "_REGION", 12 if parting else 10_000)
    monkeypatch.setattr(jaccard, "_PIVOTS", 6)
    monkeypatch.setattr(jaccard, "_TILE", 5)
    monkeypatch.setattr(jaccard, "_BLOCK_CLASSES", 20)
    rng = random.Random(11)
    shared = [f"p{i}" for i in range(60)]
    # six families of texts around one shared passage: near within a family, apart between them
    rows = []
    for family in range(6):
        own = [f"f{family}w{i}" for i in range(90)]
        for k in range(14):
            text = list(own)
            text[rng.randrange(90)] = f"x{family}y{k}"
            if k % 5 == 0:
                text[rng.randrange(90)] = f"z{k}"
            rows.append((len(rows), " ".join(shared[: 10 + family] + text), "en", "s", 1, 0.5, "k", 1))
    shingles = [frozenset(tuple(r[1].split()[i : i + 5]) for i in range(len(r[1].split()) - 4)) for r in rows]
    want = Counter((r[0], sum(s != t and 100 * len(s & t) >= 75 * len(s | t) for t in set(shingles))) for r, s in zip(rows, shingles, strict=True))
    got = jaccard.join(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == want
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(rows))


def test_jaccard_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert jaccard.join(df).count() == 0
    assert jaccard.representatives(df).count() == 0


def brute_repeats(rows, window=13):
    first = {}
    words = [space_words(r[1]) for r in rows]
    for r, w in zip(rows, words, strict=True):
        if r[0] is not None:
            for i in range(len(w) - window + 1):
                g = tuple(w[i : i + window])
                first[g] = min(first.get(g, r[0]), r[0])
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if r[0] is not None and first[tuple(w[i : i + window])] < r[0]:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 4])
@pytest.mark.parametrize("block", [1 << 20, 50])
def test_repeated_spans_equal_brute_force(spark, seed, block, monkeypatch):
    monkeypatch.setattr(substrings, "_BLOCK", block)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = substrings.repeated_spans(df).collect()
    # rows of one id but different texts share their answers by window, so each row is judged by its own text
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter(brute_repeats(rows))
    texts = {}
    for doc, text, *_ in rows:
        texts.setdefault(doc, []).append(space_words(text))
    for r in got:
        assert len({w for s in r.spans for w in range(s.start, s.stop)}) == r.n_removed
        for s in r.spans:
            assert s.source < r.doc_id
            n = s.stop - s.start
            sources = {" ".join(w[s.source_start : s.source_start + n]) for w in texts[s.source] if len(w) >= s.source_start + n}
            assert bytes(s.sha256) in {hashlib.sha256(x.encode()).digest() for x in sources}
            assert any(" ".join(w[s.start : s.stop]) in sources for w in texts[r.doc_id])


def test_spans_are_confirmed_by_their_sources(spark):
    words = [f"w{i}" for i in range(700)]
    rows = [(1, " ".join(["a", *words, "b"])), (2, " ".join(["c", *words[:650]])), (3, " ".join(words[5:30])), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: [(s.start, s.stop, s.source, s.source_start) for s in r.spans] for r in substrings.repeated_spans(df).collect()}
    assert spans == {1: [], 2: [(1, 268, 1, 1), (256, 524, 1, 256), (512, 651, 1, 512)], 3: [(0, 25, 1, 6)], 4: []}

    def asked(start, stop, source, at, text):
        one = [(start, stop, source, at, bytearray(hashlib.sha256(text.encode()).digest()))]
        return spark.createDataFrame([(one,)], f"spans {substrings._SPANS_SQL}")

    assert substrings.confirmed(df, asked(0, 20, 1, 6, " ".join(words[5:25])))
    assert not substrings.confirmed(df, asked(0, 20, 1, 7, " ".join(words[5:25])))
    assert not substrings.confirmed(df, asked(0, 20, 1, 695, " ".join(words[694:])))  # past the source's end
    assert not substrings.confirmed(df, asked(0, 20, 9, 6, " ".join(words[5:25])))  # no such source


def test_without_repeats_keeps_columns_and_clean_texts(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, SCHEMA)
    out = substrings.without_repeats(df)
    assert out.columns == df.columns
    judged = Counter()
    for r, (_, n, removed, _) in zip(rows, brute_repeats(rows), strict=True):
        if not removed:
            judged[r[0], r[1]] += 1
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    assert all(kept[k] >= c for k, c in judged.items())
    assert sum(kept.values()) == sum(1 for _, n, removed, _ in brute_repeats(rows) if removed < n or not removed)


def test_repeats_empty(spark):
    assert substrings.repeated_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (500, 501), (501, 500)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 500: 500, 501: 500}


def test_columns_named_like_internal_ones(spark):
    rows = [(r[0], r[1], r[4], 1, 2, 3, 4) for r in corpus(7, n=20, hot=6)]
    names = ["__doc", "__answers", "__n_words", "__digest"]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    bench = spark.createDataFrame([(1, "w1x7 w2x1 w3x8")], "item_id long, text string")
    machine = toxicity.Machine(0.0, np.zeros(1 << toxicity.BITS), np.zeros((1 << toxicity.BITS, 1)))
    plain = df.drop(*names)
    for run in (jaccard.representatives, substrings.without_repeats, lambda d: decontaminate.clean(d, bench), lambda d: toxicity.keep_clean(d, machine)):
        out = run(df)
        assert out.columns == df.columns
        assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, run(plain).select("doc_id", "text").collect()))
        assert {tuple(r) for r in out.select(*names).distinct().collect()} <= {(1, 2, 3, 4)}
