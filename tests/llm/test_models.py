import random

import numpy as np
import pytest
from helpers import SCHEMA, corpus

from cellweave.llm import language, toxicity

LETTERS = {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "éèàüößñç"}


def texts_of(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(LETTERS))
        words = ["".join(rng.choices(LETTERS[lang], k=rng.randint(2, 7))) for _ in range(rng.randint(4, 40))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_bundles_equal_a_plain_sum_over_ngrams():
    texts = ["Ab, c é", "", "a", "12 3", "xyz" * 50]
    d = 256
    got = language.bundles(texts, d)
    for text, v in zip(texts, got, strict=True):
        s = "".join(c if c.isalpha() else " " for c in text.lower())
        s = " " + " ".join(s.split()) + " " if s.split() else ""
        want = np.zeros(d)
        for i in range(len(s) - 2):
            grams = [np.roll(language.letter_vectors(np.array([0 if c == " " else ord(c)]), d)[0].astype(int), 2 - j) for j, c in enumerate(s[i : i + 3])]
            want += grams[0] * grams[1] * grams[2]
        assert np.array_equal(v, want)


def test_query_equals_plain_profiles(spark, tmp_path):
    """op1 against profiles that are summed letter by letter, from the rows that the query may learn from."""
    import zlib

    from cellweave.llm.queries import QUERIES

    rows = [*texts_of(5, 24), (100, None, "aa"), (101, "12 !", "bb"), (102, "abc", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"file://{tmp_path}/documents.parquet")
    d = language.DIMENSIONS

    def bundle(text):
        s = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
        s = f" {s} " if s else ""
        out = np.zeros(d)
        for i in range(len(s) - 2):
            a, b, c = (np.roll(language.letter_vectors(np.array([0 if x == " " else ord(x)]), d)[0].astype(float), 2 - j) for j, x in enumerate(s[i : i + 3]))
            out += a * b * c
        return out

    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows}
    names = sorted({lang for i, t, lang in rows if not held[i] and lang and np.any(bundle(t))})
    prototypes = [unit(sum(unit(bundle(t)) for i, t, lang in rows if lang == name and t is not None and not held[i])) for name in names]
    mean = np.mean(prototypes, axis=0)
    centred = [unit(p - mean) for p in prototypes]
    got = {r.doc_id: r for r in QUERIES["op1_profiles"](spark, f"file://{tmp_path}").collect()}
    assert len(got) == len(rows) and any(held.values())
    for i, text, _ in rows:
        v = bundle(text)
        cosine = [unit(unit(v) - mean) @ p for p in centred]
        assert got[i].held_out == held[i]
        assert got[i].lang_pred == (names[int(np.argmax(cosine))] if v.any() else "und")
        assert np.isclose(got[i].score, max(0.0, max(cosine)) if v.any() else 0.0, atol=1e-4)


def test_held_out_accuracy_and_edge_cases(spark):
    train = spark.createDataFrame(texts_of(1), "doc_id long, text string, lang string")
    profiles = language.learn(train)
    test = texts_of(2)
    odd = [(900, None, "aa"), (901, "", None), (902, "12 34 !", "bb"), (903, "a", "aa"), (None, "abcd abc", None), (0, "éèà", "cc"), (0, "éèà", "cc")]
    df = spark.createDataFrame(test + odd, "doc_id long, text string, lang string").selectExpr("doc_id", "text", "lang", "'x' AS score", "1 AS lang_pred")
    got = language.identify(df, profiles).collect()
    assert len(got) == len(test) + len(odd)
    want = {i: lang for i, _, lang in test}
    right = [r.lang_pred == want[r.doc_id] for r in got if r.doc_id in want and r.doc_id != 0]
    assert np.mean(right) >= 0.95
    by = {r.doc_id: r for r in got}
    assert by[900].lang_pred == by[901].lang_pred == by[902].lang_pred == "und" and by[900].score == 0
    assert by[903].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got)


def test_language_without_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.learn(empty) is None
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert language.identify(df, None).collect()[0].lang_pred == "und"
    assert language.identify(empty, language.learn(spark.createDataFrame(texts_of(1), "doc_id long, text string, lang string"))).count() == 0


def test_language_sample_is_bounded(spark):
    df = spark.createDataFrame(texts_of(3, 200), "doc_id long, text string, lang string")
    assert language.learn(df, max_train=60).names == sorted(LETTERS)


def toxic_rows(seed, n=400):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 40))]
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        for flag, word in ((insult, "dolt"), (group, "folk")):
            if flag:
                words.insert(rng.randrange(len(words)), word)
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(insult and group)))  # only the pair is toxic
    return rows, labels


def test_machine_learns_a_pair_that_weights_cannot(spark):
    rows, labels = toxic_rows(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    machine = toxicity.learn(docs.where("doc_id % 3 <> 1"), known.where("doc_id % 3 <> 1"))
    score = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    held = [(score[i] >= 0.7, y == 1) for i, _, y in labels if i % 3 == 1]
    assert np.mean([a == b for a, b in held]) >= 0.95


def xor_rows(seed, n):
    """Toxic with one of two words but not both: neither tells anything alone."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(100)}" for _ in range(rng.randint(5, 20))]
        one, other = rng.random() < 0.5, rng.random() < 0.5
        words += ["dolt"] * one + ["folk"] * other
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(one != other)))
    return rows, labels


def test_machine_learns_a_pair_of_neutral_terms(spark):
    rows, labels = xor_rows(2, 3000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    machine = toxicity.learn(docs.where("doc_id % 3 <> 1"), known.where("doc_id % 3 <> 1"))  # as shipped
    score = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    high = [score[i] for i, _, y in labels if i % 3 == 1 and y]
    low = [score[i] for i, _, y in labels if i % 3 == 1 and not y]
    assert np.mean([[h > x for x in low] for h in high]) >= 0.9


def test_machine_logit_is_the_double_sum():
    rng = np.random.default_rng(3)
    machine = toxicity.Machine(0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    sets = [[], [4], [0, 1, 2, 8], [3, 5], list(range(9))]
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    got = machine.logits(rows, np.array([b for s in sets for b in s]), len(sets))
    want = [0.3 + sum(machine.w[i] for i in s) + sum(machine.v[i] @ machine.v[j] for i in s for j in s if i < j) for s in sets]
    assert np.allclose(got, want)


def test_machine_is_fitted_to_a_minimum():
    rng = np.random.default_rng(0)
    rows = np.repeat(np.arange(6), 3)
    at = np.concatenate([rng.choice(5, 3, replace=False) for _ in range(6)])
    y = np.array([0, 1, 0, 1, 1, 0])
    machine = toxicity.fit(rows, at, y, np.ones(5), factors=2, steps=200, decay=1e-3)

    def loss(m):
        p = 1 / (1 + np.exp(-m.logits(rows, at, 6)))
        each = np.where(y == 1, 2.0, 1.0)
        return -(each / each.sum() * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() + 0.5e-3 * ((m.w**2).sum() + (m.v**2).sum())

    base = loss(machine)
    for i in range(5):  # near a minimum no small step lowers the loss by much
        for step in (1e-3, -1e-3):
            moved = toxicity.Machine(machine.w0, machine.w.copy(), machine.v)
            moved.w[i] += step
            assert loss(moved) > base - 1e-4


def test_training_pairs_are_bounded(spark):
    rows, labels = toxic_rows(4, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.learn(docs, known, max_pairs=500).v.shape == (1 << toxicity.BITS, 4)
    least = toxicity.learn(docs, known, max_pairs=0)  # one row of each label
    assert least.w.any() and -10 < least.w0 < 10


def test_a_labelled_id_that_is_repeated_doesnt_use_up_the_bound(spark):
    rows, labels = toxic_rows(4, 300)
    own = labels[0][0]
    again = [(own, dict((r[0], r[1]) for r in rows)[own], "en")] * 400
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    schema = "doc_id long, text string, lang string"
    a = toxicity.learn(spark.createDataFrame(rows, schema), known, max_pairs=2500)
    b = toxicity.learn(spark.createDataFrame(rows + again, schema), known, max_pairs=2500)
    assert np.allclose(a.w, b.w, atol=1e-4) and np.isclose(a.w0, b.w0, atol=1e-3) and a.w.any()
    long = [(10_000_000, " ".join(f"x{i}" for i in range(5000)), "en")]  # fits nowhere, whatever its place
    more = spark.createDataFrame([*labels, (10_000_000, 0, 0)], "doc_id long, quality int, toxic int")
    c = toxicity.learn(spark.createDataFrame(rows + long, schema), more, max_pairs=2500)
    assert np.count_nonzero(c.w) > 100


def test_toxicity_edge_cases(spark):
    df = spark.createDataFrame(corpus(1, n=20, hot=4), SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    machine = toxicity.learn(df, none)
    got = toxicity.score(df, machine).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 0.5 for r in got)
    one = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (None, 0, 1), (3, 1, None), (4, 1, 7)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.99 for r in toxicity.score(df, toxicity.learn(df, one)).collect())
    kept = toxicity.keep_clean(df, machine)  # df has a column named score
    assert kept.columns == df.columns and kept.count() == df.count()
    assert toxicity.score(spark.createDataFrame([], SCHEMA), machine).count() == 0


@pytest.mark.parametrize("texts", [["", None], ["x"]])
def test_scores_of_tiny_tables(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    machine = toxicity.Machine(0.0, np.zeros(1 << toxicity.BITS), np.zeros((1 << toxicity.BITS, 1)))
    assert [r.score for r in toxicity.score(df, machine).collect()] == [0.5] * len(texts)
