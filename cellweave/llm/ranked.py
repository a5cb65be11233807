"""Exact ranked retrieval: range-maximum tables over posting lists, intervals of documents best first.

The terms of the items (a stated query set, taken in blocks of at most about ``item_terms`` term
occurrences) are looked up in every whole document; a document's row of the index holds its number of
terms and, for each term that some item asks for, its occurrences.  Numbers of documents and
occurrences are summed over all documents by Spark before anything is scored.

Search works on blocks of documents inside each task.  A block has its postings sorted by term and document,
with the impact (the term's share of a score) of each, and sparse tables that give the position of the greatest
impact in any stretch of a posting list.  An item starts with the interval of all documents of the
block.  An interval's bound is the sum, over the item's terms, of the greatest impact inside it.  The
intervals of the greatest bounds are taken first; each is split at the document of the greatest single impact, which is
scored, and the parts on either side are bounded by range-maximum queries again; intervals of few
postings are scored whole.  An item is done when no interval's bound reaches the score of its
last place, so no document is left out that belongs to the answer.  Documents of a block are arranged by their
most frequent term, which brings languages together and keeps bounds low.  The best of a task go on
from block to block; the best of all tasks are merged in two steps, so that no task
takes all rows of an item when there are many.

Words are found by 64-bit hashes and compared byte by byte with the item's term.  Memory: ``block_postings`` bounds a block, a single
longer document is one of its own.

Edge cases: null, empty and wordless texts have no terms, are not counted and not found; an item without
terms, or whose terms no document holds, has no rows; each row of either table is a document or an item of its own, so
repeated rows are ranked one by one; ties go to the smaller doc_id, null ids last; empty tables
give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _runtime as R
from . import _words as W

_LAST = np.iinfo(np.int64).max


class Vocabulary:
    """The distinct terms of a block of items, found by hash and told by their bytes."""

    def __init__(self, terms: Sequence[bytes]):
        lengths = np.array([len(t) for t in terms], np.int64)
        data = np.frombuffer(b" ".join(terms), np.uint8)
        starts = np.cumsum(lengths + 1) - lengths - 1
        seed = 1
        while True:
            hashes = W.word_hashes(data, starts, starts + lengths, W.ALNUM_LOWER, seed)
            order = np.argsort(hashes, kind="stable")
            if len(hashes) < 2 or (np.diff(hashes[order]) != 0).all():
                break
            seed += 1
        self.seed, self.hashes, self.order = seed, hashes[order], order
        self.data, self.starts, self.lengths = data, starts, lengths

    def find(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which words, term of each) of the words that are terms."""
        if not len(starts) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = W.word_hashes(data, starts, stops, W.ALNUM_LOWER, self.seed)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        which = np.flatnonzero(self.hashes[at] == h)
        term = self.order[at[which]]
        size = (stops - starts)[which]
        same = size == self.lengths[term]
        which, term, size = which[same], term[same], size[same]
        if len(which):
            first = np.cumsum(size) - size
            inner = np.arange(int(size.sum())) - np.repeat(first, size)
            alike = W.ALNUM_LOWER.fold[data[np.repeat(starts[which], size) + inner]] == self.data[np.repeat(self.starts[term], size) + inner]
            same = np.minimum.reduceat(alike, first)
            which, term = which[same], term[same]
        return which, term


@dataclass(frozen=True)
class Items:
    """Items of one block: ids, and each one's terms with their repeats."""

    ids: list
    terms: list[np.ndarray]
    repeats: list[np.ndarray]
    vocabulary: list[bytes]

    @classmethod
    def of(cls, rows: list[tuple[object, list[str]]]) -> Items:
        places: dict[str, int] = {}
        ids, terms, repeats = [], [], []
        for item, words in rows:
            counts = Counter(words)
            ids.append(item)
            terms.append(np.array([places.setdefault(t, len(places)) for t in counts], np.int64))
            repeats.append(np.array(list(counts.values()), np.int64))
        return cls(ids, terms, repeats, [t.encode() for t in places])


class Block:
    """Postings of a block of documents by term and document, with range-maximum tables."""

    def __init__(self, doc_ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, weights: np.ndarray):
        n = len(doc_ids)
        rows = np.repeat(np.arange(n), sizes)
        impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * lengths[rows]))
        # languages side by side: documents in the order of their most frequent term
        lead = np.full(n, -1, np.int64)
        filled = np.flatnonzero(sizes)
        if len(filled):
            key = tf * (len(weights) + 1) + terms
            lead[filled] = np.maximum.reduceat(key, (np.cumsum(sizes) - sizes)[filled]) % (len(weights) + 1)
        order = np.argsort(lead, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        some = impact > 0
        key = terms[some] * n + place[rows[some]]
        by = np.argsort(key, kind="stable")
        self.n, self.doc_ids = n, doc_ids[order]
        self.key, self.impact = key[by], impact[some][by]
        self.tables = [np.arange(len(self.key), dtype=np.int32)]
        self.log = np.zeros(1, np.int64)
        if len(self.key):
            counts = np.bincount(self.key // n)
            self.log = np.frexp(np.arange(int(counts.max()) + 1))[1] - 1
            for k in range(1, int(self.log[-1]) + 1):
                last, half = self.tables[-1], 1 << (k - 1)
                a, b = last[:-half], last[half:]
                self.tables.append(np.where(self.impact[a] >= self.impact[b], a, b))

    def greatest(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and impact of the greatest impact among postings lo..hi-1 (0 where there is none)."""
        at = np.zeros(lo.shape, np.int64)
        value = np.zeros(lo.shape, np.int64)
        some = np.flatnonzero(hi > lo)
        if len(some):
            a, b = lo.ravel()[some], hi.ravel()[some]
            k = self.log[b - a]
            p, q = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
            for level in np.unique(k):
                own = k == level
                table = self.tables[level]
                p[own], q[own] = table[a[own]], table[b[own] - (1 << int(level))]
            best = np.where(self.impact[p] >= self.impact[q], p, q)
            at.ravel()[some], value.ravel()[some] = best, self.impact[best]
        return at, value

    def best(self, terms: np.ndarray, repeats: np.ndarray, top: Best, leaf: int, width: int) -> None:
        """Adds to ``top`` the block's documents that belong there."""
        n, base = self.n, terms * self.n

        def stretches(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return np.searchsorted(self.key, base[None, :] + begin[:, None]), np.searchsorted(self.key, base[None, :] + end[:, None])

        def push(begin: np.ndarray, end: np.ndarray) -> None:
            lo, hi = stretches(begin, end)
            at, value = self.greatest(lo, hi)
            value *= repeats
            bound, lead = value.sum(1), value.argmax(1)
            for i in np.flatnonzero(bound >= max(top.least, 1)).tolist():
                split = int(self.key[at[i, lead[i]]]) % n
                heapq.heappush(heap, (-int(bound[i]), int(begin[i]), int(end[i]), split, lo[i], hi[i]))

        heap: list[tuple] = []
        push(np.array([0]), np.array([n]))
        while heap and -heap[0][0] >= max(top.least, 1):
            taken = []
            while heap and len(taken) < width and -heap[0][0] >= max(top.least, 1):
                taken.append(heapq.heappop(heap))
            whole = [x for x in taken if int((x[5] - x[4]).sum()) <= leaf]
            parted = [x for x in taken if int((x[5] - x[4]).sum()) > leaf]
            if whole:
                self._score_all(np.stack([x[4] for x in whole]), np.stack([x[5] for x in whole]), repeats, top)
            if parted:
                begin, end, split = (np.array([x[k] for x in parted]) for k in (1, 2, 3))
                at = np.minimum(np.searchsorted(self.key, base[None, :] + split[:, None]), len(self.key) - 1)
                scores = np.where(self.key[at] == base[None, :] + split[:, None], self.impact[at] * repeats, 0).sum(1)
                top.add(scores, self.doc_ids[split])
                begin, end = np.concatenate([begin, split + 1]), np.concatenate([split, end])
                push(begin[end > begin], end[end > begin])

    def _score_all(self, lo: np.ndarray, hi: np.ndarray, repeats: np.ndarray, top: Best) -> None:
        """Scores every document of some intervals."""
        sizes = (hi - lo).ravel()
        first = np.cumsum(sizes) - sizes
        at = np.repeat(lo.ravel() - first, sizes) + np.arange(int(sizes.sum()))
        doc = self.key[at] % self.n
        value = self.impact[at] * np.repeat(np.broadcast_to(repeats, lo.shape).ravel(), sizes)
        order = np.argsort(doc, kind="stable")
        doc, value = doc[order], value[order]
        begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        top.add(np.add.reduceat(value, begins), self.doc_ids[doc[begins]])


class Best:
    """The k best (score, document) so far; ties to the smaller document."""

    def __init__(self, k: int):
        self.k, self.scores, self.docs, self.least = k, np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        some = scores >= max(self.least, 1)
        if not some.any():
            return
        scores, docs = np.concatenate([self.scores, scores[some]]), np.concatenate([self.docs, docs[some]])
        order = np.lexsort((docs, -scores))[: self.k]
        self.scores, self.docs = scores[order], docs[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def index(documents: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n, terms, tf of every document that has a term: occurrences of the vocabulary's terms."""
    shared = documents.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = R.text_buffers(batch.column("text"))
            ids = batch.column("doc_id")
            for a, b in R.chunks(offsets):
                starts, stops, rows = W.words(data, offsets[a : b + 1], W.ALNUM_LOWER)
                n = np.bincount(rows, minlength=b - a)
                which, term = shared.value.find(data, starts, stops)
                size = max(len(vocabulary), 1)
                key, tf = np.unique(rows[which] * size + term, return_counts=True)
                counts = np.bincount(key // size, minlength=b - a)
                made = pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n, pa.int64()), R.list_column(key % size, counts, pa.int32()), R.list_column(tf, counts, pa.int32())], names=["doc_id", "n", "terms", "tf"])
                yield made.filter(pa.array(n > 0))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def frequencies(found: DataFrame, size: int) -> np.ndarray:
    """Documents of each term, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.asarray(batch.column("terms").flatten()), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for row in found.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row.term] = row.df
    return out


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def length_norms(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """100 - 25 + (25 n N) div L."""
    if len(n) and int(n.max()) * 25 * documents >= 1 << 63:
        return np.array([75 + 25 * int(x) * documents // terms for x in n], np.int64)
    return 75 + 25 * n * documents // terms


def search(documents: DataFrame, items: DataFrame, k: int = 20, item_terms: int = 500_000, block_postings: int = 1_000_000, leaf: int = 2_048, width: int = 16) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every row of ``items``."""
    spark = R.prepare(documents.sparkSession)
    folded = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = items.select("item_id", F.regexp_extract_all(folded, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1).alias("words")).where(F.size("words") > 0)
    total = asked.agg(F.sum(F.size("words"))).first()[0] or 0
    n_blocks = max(1, -(-total // item_terms))
    out = None
    for b in range(n_blocks):
        rows = asked if n_blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n_blocks)) == b)
        own = Items.of([(r.item_id, r.words) for r in rows.collect()])
        if own.ids:
            part = _search(documents, own, items.schema["item_id"].dataType, k, block_postings, leaf, width)
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return out


def _search(documents: DataFrame, items: Items, kind, k: int, block_postings: int, leaf: int, width: int) -> DataFrame:  # noqa: ANN001
    spark = documents.sparkSession
    found = R.written(index(documents, items.vocabulary), "postings")
    n, total = found.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = frequencies(found, len(items.vocabulary))
    weights = np.array([weight(n, int(x)) if x else 0 for x in df], np.int64)
    shared = spark.sparkContext.broadcast((items.terms, items.repeats, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, repeats, weights = shared.value
        tops = [Best(k) for _ in terms]
        held: list[tuple] = []

        def work() -> None:
            parts = [np.concatenate(p) for p in zip(*held, strict=True)]
            held.clear()
            parts[1] = length_norms(parts[1], n, total)
            block = Block(*parts, weights)
            for t, r, top in zip(terms, repeats, tops, strict=True):
                block.best(t, r, top, leaf, width)

        size = 0
        for batch in batches:
            ids = batch.column("doc_id")
            ids = np.where(np.asarray(ids.is_null()), _LAST, np.asarray(ids.fill_null(0)))
            lists, tf = batch.column("terms"), batch.column("tf")
            offsets = np.asarray(lists.offsets).astype(np.int64)
            for a, b in R.chunks(offsets, block_postings):
                own = int(offsets[b] - offsets[a])
                if held and size + own > block_postings:
                    work()
                    size = 0
                at = slice(int(offsets[a]), int(offsets[b]))
                held.append((ids[a:b], np.asarray(batch.column("n"))[a:b], np.diff(offsets[a : b + 1]), np.asarray(lists.values)[at].astype(np.int64), np.asarray(tf.values)[int(tf.offsets[a].as_py()) : int(tf.offsets[b].as_py())].astype(np.int64)))
                size += own
        if held:
            work()
        item = np.repeat(np.arange(len(tops)), [len(t.docs) for t in tops])
        docs = np.concatenate([t.docs for t in tops])
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(docs, pa.int64(), mask=docs == _LAST), pa.array(np.concatenate([t.scores for t in tops]), pa.int64())], names=["item", "doc_id", "score"])

    best = found.mapInArrow(run, "item long, doc_id long, score long")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    some = best.withColumn("part", F.spark_partition_id() % 64)
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("place") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    from pyspark.sql import types as T

    ids = spark.createDataFrame(list(enumerate(items.ids)), T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind)]))
    return ranked.join(ids, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def brute_force(documents: Sequence[tuple[int | None, str | None]], items: Sequence[tuple[object, str | None]], k: int = 20) -> list[tuple]:
    """(item_id, rank, doc_id, score) on small tables, for tests."""
    import re

    def words(text: str | None) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))

    counted = [(i, Counter(words(t))) for i, t in documents]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(weight(n, df[t]) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out
