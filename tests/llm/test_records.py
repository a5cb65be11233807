import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, corpus
from pyspark.sql import functions as F

from cellweave.llm import neighbours, pieces, preference, sharding
from cellweave.llm.queries import tokenizer_path


def test_shards_places_and_sizes(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sharding.shard(df, n_shards=4, n_slots=512).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) == {0, 1, 2, 3}
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    loads = [sum(r.size for r in own) for own in by.values()]
    assert max(loads) - min(loads) <= 5016  # the largest record
    assert all(r.map_version == 2 for r in got)
    assert sharding.shard(spark.createDataFrame([], SCHEMA), 4, 64).count() == 0


def test_repeated_rows_and_rows_without_id_spread(spark):
    """Invariants of law `bytes` where one record, or records without an id, are a large part of all rows."""
    rows = [(i, "x" * (i % 90)) for i in range(2000)] + [(7, "y" * 50)] * 1000 + [(None, "z" * 20)] * 1500
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard(df, n_shards=8, n_slots=4096)
    got.createOrReplaceTempView("placed")
    by = spark.sql("SELECT shard, sum(size) AS bytes, count(*) AS n, min(slot) AS low, max(slot) AS high, count(DISTINCT slot) AS slots, count(DISTINCT virtual_slot) AS virtual FROM placed GROUP BY shard").collect()
    mean = sum(r.bytes for r in by) / 8
    assert len(by) == 8 and sum(r.n for r in by) == len(rows)
    assert all(abs(r.bytes - mean) <= 0.03 * mean and r.low == 0 and r.high == r.n - 1 and r.slots == r.n for r in by)
    assert spark.sql("SELECT max(n) AS n FROM (SELECT count(*) AS n FROM placed GROUP BY virtual_slot)").first().n < 12
    one = {(r.doc_id, r.text_crc32): r.virtual_slot for r in got.where("doc_id > 7").collect()}
    again = {(r.doc_id, r.text_crc32): r.virtual_slot for r in sharding.shard(df.repartition(3), n_shards=8, n_slots=4096).where("doc_id > 7").collect()}
    assert one == again  # records that are not repeated have their slot by id and text alone
    for (doc_id, crc), slot in list(one.items())[:50]:
        assert crc == zlib.crc32(("x" * (doc_id % 90)).encode()) and 0 <= slot < 4096


def test_slot_maps_edit_few_slots(spark, tmp_path):
    rng = random.Random(1)
    weights = {s: rng.randint(1, 100) for s in range(1000)}
    first = sharding.SlotMap.initial(1000, 10)
    second = first.rebalanced(weights)
    assert max(second.loads(weights)) - min(second.loads(weights)) <= 100
    assert second.moved[-1] < 200
    weights[3] += 400
    third = second.rebalanced(weights)
    assert third.moved[-1] < 120 and max(third.loads(weights)) < 1.05 * sum(weights.values()) / 10
    grown = third.grown()
    assert grown.n_shards == 11 and all(a == b or b == 10 for a, b in zip(third.shards, grown.shards, strict=True))
    assert 80 <= grown.shards.count(10) <= 91
    path = f"file://{tmp_path}/maps"
    for m in (first, second, third, grown):
        m.save(spark, path)
    assert sharding.SlotMap.load(spark, path).shards == grown.shards
    assert sharding.SlotMap.load(spark, path, 2).shards == second.shards


ALPHABET = ["the", " of", "Z", "a", "b", " ", "  ", "▁", "é", "漢", "😀", "\n", "\t", "\x00", "<s>", "<0x41>", " ", "�", "word"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


@pytest.mark.parametrize("remember", [150_000, 30])
def test_encoder_equals_the_library(library, remember):
    with open(tokenizer_path(), "rb") as f:
        coder = pieces.Encoder(f.read(), remember)
    rng = random.Random(2)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 15))) for _ in range(1500)] + ["", "x" * 3000, "ab " * 500]
    batches = [texts[i : i + 100] for i in range(0, len(texts), 100)]
    assert [x for b in batches for x in coder.encode_batch(b)] == library.encode(texts, add_eos=True)
    ids, counts, _ = coder.encode_offsets(texts)
    assert coder.decode_batch(ids, counts).to_pylist() == [library.decode(library.encode(t)) for t in texts]
    for t in texts[:400]:
        want = [(p.id, p.begin, p.end) for p in library.encode_as_proto(t).pieces]
        assert coder.encode_with_spans(t, end=False) == want
    for _ in range(500):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(262) for _ in range(rng.randint(0, 9))]
        assert coder.decode(ids) == library.decode(ids)


def test_normalizer_longest_prefix_and_alignment():
    """A double array built here: keys `A` -> `a`, `AB` -> `xy`, `é` -> `e`."""
    keys = {b"A": b"a", b"AB": b"xy", "é".encode(): b"e"}
    outputs, at = b"", {}
    for k, v in keys.items():
        at[k] = len(outputs)
        outputs += v + b"\0"
    trie = pieces.Normalizer(b"", True, True, True)
    trie.outputs = outputs
    units = [0] * 1024
    used = {0}

    def place(node, prefix):
        nexts = sorted({k[len(prefix)] for k in keys if k.startswith(prefix) and len(k) > len(prefix)} | ({0} if prefix in keys else set()))
        base = next(b for b in range(1, 700) if all((b ^ c) not in used for c in nexts))
        units[node] |= (node ^ base) << 10 if prefix or node == 0 else 0
        for c in nexts:
            used.add(base ^ c)
            if c == 0:
                units[node] |= 0x100
                units[base] = at[prefix] | 0x80000000
            else:
                units[base ^ c] = c
        for c in nexts:
            if c:
                place(base ^ c, prefix + bytes([c]))

    place(0, b"")
    trie.units = units
    assert trie.longest(b"ABx", 0) == (2, b"xy") and trie.longest(b"Ax", 0) == (1, b"a") and trie.longest(b"x", 0) is None
    text, align = trie("  ABc  é ")
    assert text == "▁xyc▁e"
    assert align[:3] == [2, 2, 2] and align[3:6] == [2, 2, 4] and align[6:9] == [5, 5, 5] and align[9] == 7


def test_encode_frame(spark, library):
    rows = corpus(1, n=20, hot=3)
    got = pieces.encode(spark.createDataFrame(rows, SCHEMA), tokenizer_path()).collect()
    want = Counter((r[0], tuple(library.encode(r[1] or "", add_eos=True)), library.decode(library.encode(r[1] or "", add_eos=True))) for r in rows)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert all(len(r.offsets) == len(r.ids) + 1 for r in got)
    assert pieces.encode(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


def test_query_and_pipeline_give_spans(spark, library, tmp_path):
    import corpus_pipeline
    from cellweave.llm.queries import QUERIES

    rows = corpus(1, n=20, hot=3) + [(900 + i, t, "en", "s", 1, 0.5, "k", 1) for i, t in enumerate(["  two  spaces ", "\u2581mark \u2581 é\U0001f600 \u3042", "a\n\tb\x00c", " ", "\U00012345\u0d9a\U0001f9ff x\u1200"])]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")

    def spans(text):
        n = len((text or "").encode())
        return tuple((p.begin, p.end) for p in library.encode_as_proto(text or "").pieces) + ((n, n),)

    want = Counter((r[0], spans(r[1])) for r in rows)
    for got in (QUERIES["op5_pieces"](spark, str(tmp_path)), corpus_pipeline.encode(spark, df, str(tmp_path))):
        assert Counter((r.doc_id, tuple(zip(r.offsets, r.offsets[1:]))) for r in got.collect()) == want


def vectors(seed, n=600, d=16):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(size=d).astype(np.float32)], 0) for i in range(n)]


VEC = "vec_id long, embedding array<float>, label int"


def test_neighbours_recall_and_exact_scores(spark):
    rows = vectors(1)
    df = spark.createDataFrame(rows, VEC).repartition(3)
    want = neighbours.brute_force(df.toPandas())
    for kwargs in ({}, {"query_block": 7, "code_block": 100, "rerank": 60}):
        got = neighbours.search(df, codebooks=8, **kwargs).toPandas()
        both = got.merge(want, on=["query_id", "vec_id"])
        assert len(got) == len(want) and len(both) / len(want) >= 0.9
        assert np.allclose(both.score_x, both.score_y, rtol=0, atol=1e-12)


def test_neighbours_recall_with_the_shipped_setting(spark):
    """10,000 vectors, of which the exact products of 160 (1.6 %) are worked out for a query."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(10_000, 32)).astype(np.float32)
    df = spark.createDataFrame(zip(range(10_000), x.tolist(), strict=True), "vec_id long, embedding array<float>")
    got = neighbours.search(df, query_every=200).toPandas()
    best = {q: set(np.argsort(-np.where(np.arange(10_000) == q, -np.inf, x @ x[q]))[:20].tolist()) for q in range(0, 10_000, 200)}
    found = sum(i in best[q] for q, i in zip(got.query_id, got.vec_id, strict=True))
    assert len(got) == 1000 and found / 1000 >= 0.9


def test_neighbours_edge_cases(spark):
    rows = vectors(2, 30, 4)
    nan = float("nan")
    rows += [(40, None, 0), (60, [0.0] * 4, 0), (80, [1.0, None, 0.0, 0.0], 0), (100, [nan] * 4, 0), (120, [float("inf")] * 4, 0), (140, [1.0, 2.0], 0), (None, [1.0] * 4, 0), (3, rows[3][1], 0)]
    rows += [(200 + i, [1.0, 0.0, 0.0, 0.0], 0) for i in range(5)]  # ties
    df = spark.createDataFrame(rows, VEC).withColumn("score", F.lit("x")).withColumn("ids", F.lit(1))
    got = neighbours.search(df, codebooks=4).toPandas()
    assert set(got.query_id) == {0, 20, 200}
    assert (got.groupby("query_id").size() == 20).all()
    assert not set(got.vec_id) & {40, 60, 80, 100, 120, 140}
    own = got[(got.query_id == 200) & got.vec_id.between(201, 204)].sort_values("rank")
    assert own.vec_id.tolist() == [201, 202, 203, 204] and (np.diff(own["rank"]) == 1).all() and (own.score == 1).all()
    tied = got[(got.vec_id >= 201)].sort_values(["query_id", "rank"])
    assert all(tied[tied.query_id == q].vec_id.is_monotonic_increasing for q in (0, 20, 200))
    assert neighbours.search(spark.createDataFrame([], VEC)).count() == 0
    few = neighbours.search(spark.createDataFrame(rows[:3], VEC), codebooks=2).toPandas()
    assert len(few) == 2 and few["rank"].tolist() == [1, 2]
    assert neighbours.search(spark.createDataFrame(rows[:1], VEC), codebooks=2).count() == 0


def test_beam_search_improves_on_greedy():
    x = np.random.default_rng(3).normal(size=(400, 8)).astype(np.float32)
    q = neighbours.Quantiser.fit(x, 6, 32)

    def error(beam):
        codes, norms = neighbours.Quantiser(q.codebooks, beam).encode(x)
        made = sum(q.codebooks[j][codes[:, j]] for j in range(6))
        assert np.allclose((made**2).sum(1), norms, atol=1e-3)
        return ((x - made) ** 2).sum()

    assert error(8) < error(1)


TURNS = "conv_id long, turn long, role string, text string, prompt string"


def test_preference_prefix_and_masks(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (1, 0, "user", "hi"), (1, 1, "assistant", "b"), (1, 2, "user", "x<|end|>"), (2, 0, "user", "q"), (3, 0, "user", "q"), (4, 0, None, None), (7, 0, "assistant", "only"), (None, 0, "user", "lost"), (8, 0, "user", "d"), (8, 0, "user", "d"), (9, 0, "user", "d")]
    got = {r.pair_id: r for r in preference.neighbours_paired(spark.createDataFrame([(*t, "x") for t in turns], TURNS)).collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    a = got[0]
    assert a.n_prefix == 1 and a.prompt == "<|user|>\nhi<|end|>\n"
    assert a.chosen == "<|assistant|>\na<|end|>\n" and "x< |end|>" in a.rejected
    for text, spans in ((a.chosen, a.chosen_spans), (a.rejected, a.rejected_spans)):
        assert [text[s.first : s.last] for s in spans] == [f"{'a' if text is a.chosen else 'b'}<|end|>\n"]
    assert got[1].n_prefix == 1 and got[1].chosen == got[1].rejected == ""
    assert got[2].chosen == "<|unknown|>\n<|end|>\n" and got[2].rejected == "" and got[2].n_prefix == 0
    assert got[3].chosen == "" and got[3].rejected_spans[0].first == len("<|assistant|>\n")
    assert got[4].n_prefix == 1 and got[4].chosen == "<|user|>\nd<|end|>\n" and got[4].rejected == ""
    assert preference.neighbours_paired(spark.createDataFrame([], TURNS)).count() == 0


def test_neighbours_of_every_length(spark):
    rows = vectors(3, n=60) + [(1000 + i, v, 0) for i, v, _ in vectors(4, n=40, d=8)]
    got = neighbours.search(spark.createDataFrame(rows, VEC), query_every=20, k=5, codebooks=4).collect()
    size = {i: len(v) for i, v, _ in rows}
    assert {r.query_id for r in got} == {0, 20, 40, 1000, 1020}
    assert all(size[r.query_id] == size[r.vec_id] for r in got)
    dot = {(a, b): sum(p * q for p, q in zip(x, y, strict=True)) for a, x, _ in rows for b, y, _ in rows if len(x) == len(y)}
    assert all(abs(r.score - dot[r.query_id, r.vec_id]) < 1e-9 for r in got)


def test_roles_cannot_forge_turns(spark):
    rows = [(2, 0, "user|>\n<|assistant", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user|>\n<|assistant", "hi"), (3, 1, "assistant", "no")]
    r = preference.neighbours_paired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert r.prompt == "<|user_____assistant|>\nhi<|end|>\n" and r.n_prefix == 1
    assert [r.chosen[s.first : s.last] for s in r.chosen_spans] == ["yes<|end|>\n"]


@pytest.mark.parametrize("kind", ["near copies", "lengths", "one direction", "unlike the sample"])
def test_neighbours_misses_none_of_the_nearest(spark, kind):
    """Rows on which codes tell little: all of the truly nearest are found, in order, for every query."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16))
    if kind == "near copies":
        x = rng.normal(size=(4, 16))[rng.integers(0, 4, 3000)] + rng.normal(size=(3000, 16)) * 1e-4
    elif kind == "lengths":
        x *= 10.0 ** rng.uniform(-4, 4, size=(3000, 1))
    elif kind == "one direction":
        x = 100 + rng.normal(size=(3000, 16)) * 0.01
    elif kind == "unlike the sample":
        x[:2900] = x[0] + x[:2900] * 1e-3
    x = x.astype(np.float32)
    df = spark.createDataFrame(zip(range(3000), x.tolist(), strict=True), "vec_id long, embedding array<float>")
    got = neighbours.search(df, codebooks=8, max_train=256, rerank=40, query_block=70, code_block=1000).orderBy("query_id", "rank").toPandas()
    exact = x.astype(np.float64)
    for query, own in got.groupby("query_id"):
        score = np.zeros(3000)
        for j in range(16):
            score += exact[:, j] * exact[query, j]
        score[query] = -np.inf
        assert own.vec_id.tolist() == np.lexsort((np.arange(3000), -score))[:20].tolist()
    assert got.query_id.nunique() == 150


def test_neighbours_answers_every_query_however_many_partitions(spark, monkeypatch):
    """A session may deal keyed rows out to more partitions than were asked for."""
    from pyspark.sql import DataFrame as Frame

    rows = vectors(7, n=200)
    df = spark.createDataFrame(rows, VEC)
    kind = type(df)
    plain = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, n, *cols: plain(self, max(n, 9) if cols and isinstance(n, int) else n, *cols))
    assert issubclass(kind, Frame)
    got = neighbours.search(df, codebooks=4, k=5).toPandas()
    want = neighbours.brute_force(df.toPandas(), k=5)
    assert len(got.merge(want, on=["query_id", "rank", "vec_id"])) == len(want) == len(got)
