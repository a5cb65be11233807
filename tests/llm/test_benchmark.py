import hashlib
import re
from collections import Counter

from helpers import SCHEMA, corpus, fold

from cellweave.llm import decontaminate
from cellweave.llm.queries import QUERIES

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ITEMS = "item_id long, text string, doc_id string"


def items_of(rows):
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 20][:6]
    items = [(i, " ".join(t.split()[2:17]), "x") for i, t in enumerate(texts)]
    items += [(90, "one", "x"), (91, None, "x"), (92, "  ", "x"), (93, texts[0].split()[4], "x"), (None, " ".join(texts[1].split()[:12]), "x"), (3, " ".join(texts[2].split()[:10]), "x"), (10, items[0][1], "x")]
    return items


def brute(rows, items):
    windows = []
    for i, text, *_ in items:
        w = re.findall(PATTERN, fold(text))
        k = min(10, len(w))
        windows += [(i, w[a : a + k]) for a in range(len(w) - k + 1)] if w else []
    out = []
    for d, text, *_ in rows:
        w = re.findall(PATTERN, fold(text))
        hit, found = set(), set()
        for i, g in windows:
            for a in range(len(w) - len(g) + 1):
                if w[a : a + len(g)] == g:
                    hit |= set(range(a, a + len(g)))
                    found.add(i)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def run(spark, rows, items, **kwargs):
    got = decontaminate.contamination(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, ITEMS), **kwargs).collect()
    return Counter((r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r.spans)) for r in got)


def test_contamination_equals_brute_force(spark):
    rows = corpus(1, n=50, hot=8)
    items = items_of(rows)
    want = Counter(brute(rows, items))
    assert run(spark, rows, items) == want
    assert run(spark, rows, items, max_block=20) == want  # several blocks of the benchmark


def test_clean_keeps_rows_without_hits(spark):
    rows = corpus(2, n=50, hot=8)
    items = items_of(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    out = decontaminate.clean(df, spark.createDataFrame(items, ITEMS))
    assert out.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((r[0], r[1]) for r, b in zip(rows, brute(rows, items), strict=True) if not b[5])


def test_nested_short_items(spark):
    """Runs of 3 to 6 word shingles start at one word with as many shingles; none may stand for another."""
    w = [f"w{i}" for i in range(12)]
    items = [(k, " ".join(w[:k]), "x") for k in range(1, 8)] + [(20 + k, " ".join(w[2 : 2 + k]), "x") for k in (3, 4, 5, 6, 10)]
    texts = [w[:4], w[:6], w, ["a", *w[:5], "b", *w[:3]], w[2:7], w[1:]]
    rows = [(i, " ".join(t), "en", "s", 1, 0.5, "k", 1) for i, t in enumerate(texts)]
    rows += [(100 + i, *r[1:]) for i, r in enumerate(rows)]
    assert run(spark, rows, items) == Counter(brute(rows, items))
    assert run(spark, rows, items, max_block=8) == Counter(brute(rows, items))


def test_empty_tables(spark):
    rows = corpus(1, n=5, hot=2)
    assert sum(run(spark, rows, []).values()) == len(rows)
    assert run(spark, [], [(1, "one two", "x")]) == Counter()


def test_query_names():
    assert [int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES] == list(range(1, 14))


def test_item_ids_are_strings(spark):
    bench = spark.createDataFrame([("q-10", "one two three"), ("q-9", "one two three")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "zero one two three four")], "doc_id long, text string")
    row = decontaminate.contamination(docs, bench).first()
    assert list(row["items"]) == ["q-10", "q-9"] and [(s.start, s.stop) for s in row.spans] == [(1, 4)]
