import corpus_pipeline


def test_stages_on_the_smallest_tables(spark):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        import pytest

        pytest.skip("no tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.R.written(stage(spark, docs, sf), name)
        assert out.columns == columns and out.dtypes == docs.dtypes
        n = out.count()
        assert 0.7 * seen <= n <= seen
        docs, seen = out, n
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == seen and last.where("NOT round_trip").count() == 0


def test_stages_on_odd_rows(spark):
    from helpers import corpus

    rows = [(i, t, "en", "s", n) for i, t, _, _, n, *_ in corpus(1, n=30, hot=6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, sf)
            if name != "pieces":
                assert out.columns == docs.columns
            out.count()


def test_every_stage_equals_brute_force(spark, tmp_path):
    """Each stage on all that the one before it kept, against plain Python on the same rows."""
    import random
    import re

    import sentencepiece
    from helpers import corpus, fold, space_words
    from test_benchmark import PATTERN
    from test_pairs import brute_components

    from cellweave.llm.queries import tokenizer_path

    rng = random.Random(3)
    rows = [(k, r[1], r[2], r[3], r[4]) for k, r in enumerate(corpus(7, n=60, hot=14))]
    foul = [(1000 + k, " ".join([*rng.choices(["calm", "rain", "tree", "walk", "song"], k=12), "vile", "scum", "vile"]), "en", "s", 9) for k in range(40)]
    mild = [(2000 + k, " ".join(rng.choices([f"m{i}" for i in range(900)], k=14)), "en", "s", 9) for k in range(60)]
    texts = [r[1] for r in mild]
    items = [("i1", " ".join(texts[5].split()[1:12])), ("i2", "only m1 zz"), (None, None), ("i3", " ".join(texts[9].split()[:4]))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    sf = f"file://{tmp_path}"
    docs = spark.createDataFrame(rows + foul + mild, schema)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] // 1000 == 1)) for r in foul[:25] + mild + rows[:30]], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_copies", "repeats", "benchmark", "pieces"]

    def plain(df):
        return sorted((tuple(r) for r in df.collect()), key=str)

    # toxicity: what the fitted machine scores under 0.7 stays; the foul texts go, the others stay
    machine = corpus_pipeline.toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = {(r.doc_id, r.text): r.score for r in corpus_pipeline.toxicity.score(docs, machine, ("doc_id", "text")).collect()}
    kept = plain(stages["toxicity"](spark, docs, sf))
    assert kept == sorted((r for r in rows + foul + mild if score[r[:2]] < 0.7), key=str)
    assert not {r[0] for r in kept} & {r[0] for r in foul} and {r[0] for r in mild} <= {r[0] for r in kept}

    # near copies: the least id of each component stays, as do texts without words
    found = plain(stages["near_copies"](spark, spark.createDataFrame(kept, schema), sf))
    want = sorted((r for r, (i, n, c) in zip(kept, brute_components(kept), strict=True) if not n or c == i), key=str)
    assert found == want and len(found) < len(kept)

    # repeats: words of windows that start in a document of a smaller id go, and texts of nothing else
    first = {}
    for r in found:
        w = space_words(r[1])
        for i in range(len(w) - 12):
            first[tuple(w[i : i + 13])] = min(first.get(tuple(w[i : i + 13]), r[0]), r[0])
    want = {}
    for r in found:
        w = space_words(r[1])
        gone = {p for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < r[0] for p in range(i, i + 13)}
        if not gone:
            want[r[0]] = r[1]
        elif len(gone) < len(w):
            want[r[0]] = [x for i, x in enumerate(w) if i not in gone]
    cut = plain(stages["repeats"](spark, spark.createDataFrame(found, schema), sf))
    assert {r[0]: space_words(r[1]) if isinstance(want[r[0]], list) else r[1] for r in cut} == want
    assert any(isinstance(x, list) for x in want.values())

    # benchmark: documents with a window of an item go
    windows = []
    for _, text in items:
        w = re.findall(PATTERN, fold(text))
        windows += [w[a : a + min(10, len(w))] for a in range(len(w) - min(10, len(w)) + 1)] if w else []
    hit = lambda w: any(w[a : a + len(g)] == g for g in windows for a in range(len(w) - len(g) + 1))
    clean = plain(stages["benchmark"](spark, spark.createDataFrame(cut, schema), sf))
    assert clean == sorted((r for r in cut if not hit(re.findall(PATTERN, fold(r[1])))), key=str) and len(clean) < len(cut)

    # pieces: as the library encodes and decodes
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    out = stages["pieces"](spark, spark.createDataFrame(clean, schema), sf).collect()
    ids = {r[0]: library.encode(r[1] or "", add_eos=True) for r in clean}
    assert {r.doc_id: list(r.ids) for r in out} == ids and all(r.n_tokens == len(r.ids) for r in out)
    assert all(r.round_trip == (library.decode(ids[r.doc_id]) == (next(c[1] for c in clean if c[0] == r.doc_id) or "")) for r in out)

    # the whole run is the stages in turn
    whole = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: list(r.ids) for r in whole} == ids
