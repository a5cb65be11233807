"""Hard negatives by an inverted multi-index, with certified windows.

A vector's components are floor(256 x); its two halves have a codebook each (k-means on a bounded sample,
``max_train`` rows picked by a hash of the id), and a pair of codewords is a cell.  All rows are sorted by cell
into blocks of at most ``block`` rows, so a block holds few cells and a crowded cell has many blocks.  In
every block each codeword has a radius, the largest distance of its rows' halves from it.  For an anchor
q a half's score is at most <q1, c> + |q1| radius, and the sum of the two halves' bounds is a
bound of every row in the cell.  Cells are visited in the order of these sums by the multi-sequence heap over
the two sorted lists; rows of visited cells are scored exactly, as integers.

Positives: the visit stops when no cell left can reach the last place among the rows of the anchor's
label.  Negatives: every positive has a window of scores, from ``low`` percent of its own score up to it; cells wholly above
all windows are passed over, and a window is certified when the next bound is below its lower end or below
its last place.  The visit stops when all windows are.  The answers of the blocks are merged by rank, so results are
exact; codebooks and blocks only decide what need not be scored.

Anchors meet every block (a stated query set against all rows), in blocks of ``anchor_block``, so a task's memory is
bounded whatever the number of rows.

Edge cases: rows with a null id or label, a null vector, or a null, NaN or infinite component take no part; repeated rows
of one id are one row (the least by label and vector); vectors are compared with those of
their own length; ties go to the smaller id; anchors without positives, and positives whose window is empty (all negative scores have
one), give no rows; an empty table gives an empty result; other columns are ignored.  Scores have to fit
64 bits: larger components are an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _runtime as R


def integer_rows(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v of the rows that take part; every seventh id has the next label."""
    x, infinite = F.col("embedding"), F.lit(float("inf"))
    label = F.col("label").cast("long")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.cast("array<double>").alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < infinite)))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", moved.alias("label"), F.transform("x", lambda c: F.floor(256 * c).cast("long")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")


class Halves:
    """Codebooks of the two halves of vectors of one length."""

    def __init__(self, books: list[np.ndarray], cut: int):
        self.books, self.cut = books, cut

    @classmethod
    def fit(cls, sample: np.ndarray, words: int = 32, rounds: int = 8, seed: int = 13) -> Halves:
        cut = (sample.shape[1] + 1) // 2
        rng = np.random.Generator(np.random.PCG64(seed))
        books = []
        for x in (sample[:, :cut], sample[:, cut:]):
            k = min(words, len(x))
            centres = x[rng.choice(len(x), k, replace=False)].copy()
            for _ in range(rounds):
                own = _nearest(x, centres)
                sums = np.zeros_like(centres)
                np.add.at(sums, own, x)
                counts = np.bincount(own, minlength=k)
                centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
            books.append(centres)
        return cls(books, cut)

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut :]

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = (_nearest(p, book) for p, book in zip(self.parts(x), self.books, strict=True))
        return first, second


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *[(x[a : a + 8192] @ centres.T - half).argmax(1) for a in range(0, len(x), 8192)]])


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows with one vector."""
    largest = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * len(q)
    if largest < 1 << 53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if largest >= 1 << 63:
        raise ArithmeticError("scores don't fit 64 bits")
    return x @ q


class Cells:
    """The rows of one block by cell, with a radius for each codeword of each half."""

    def __init__(self, halves: Halves, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        x = v.astype(np.float64)
        codes = halves.codes(x)
        order = np.lexsort((ids, codes[1], codes[0]))
        self.ids, self.labels, self.v = ids[order], labels[order], v[order]
        self.halves, self.words, self.radii, own = halves, [], [], []
        for part, code, book in zip(halves.parts(x), codes, halves.books, strict=True):
            there, at = np.unique(code, return_inverse=True)
            radius = np.zeros(len(there))
            np.maximum.at(radius, at, np.sqrt(((part - book[code]) ** 2).sum(1)))
            self.words.append(there)
            self.radii.append(radius)
            own.append(at[order])
        cell = own[0] * len(self.words[1]) + own[1]
        edges = np.searchsorted(cell, np.arange(len(self.words[0]) * len(self.words[1]) + 1))
        self.begins, self.ends = edges[:-1].tolist(), edges[1:].tolist()

    def half_bounds(self, q: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Upper and lower bounds of a half's score, for the codewords of each half."""
        upper, lower = [], []
        for part, book, words, radius in zip(self.halves.parts(q[None, :].astype(np.float64)), self.halves.books, self.words, self.radii, strict=True):
            centre = book[words] @ part[0]
            reach = np.sqrt((part[0] ** 2).sum()) * radius
            slack = 1e-6 + 1e-9 * (np.abs(book[words]) @ np.abs(part[0]) + reach)  # rounding of what is above
            upper.append(centre + reach + slack)
            lower.append(centre - reach - slack)
        return upper, lower

    def visit(self, q: np.ndarray, search: _Positives | _Negatives, at_once: int = 512) -> int:
        """Hands cells' rows to ``search`` in the order of their bounds until it needs no more; how many were scored."""
        upper, lower = self.half_bounds(q)
        order = [np.argsort(-u, kind="stable") for u in upper]
        s, t = (u[o].tolist() for u, o in zip(upper, order, strict=True))
        low = [x[o].tolist() for x, o in zip(lower, order, strict=True)]
        rows, columns = (o.tolist() for o in order)
        width, scored = len(columns), 0
        heap = [(-(s[0] + t[0]), 0, 0)]
        taken: list[int] = []  # begin and end of cells that wait to be scored
        waiting = 0

        def score() -> int:
            at = np.concatenate([np.arange(a, b) for a, b in zip(taken[::2], taken[1::2], strict=True)])
            search.add(products(self.v[at], q), self.ids[at], self.labels[at])
            taken.clear()
            return len(at)

        while heap:
            bound, i, j = heapq.heappop(heap)
            if -bound < search.need:
                break
            if j + 1 < width:  # each cell is pushed once: along its row, and the first column downwards
                heapq.heappush(heap, (-(s[i] + t[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(s):
                heapq.heappush(heap, (-(s[i + 1] + t[0]), i + 1, 0))
            cell = rows[i] * width + columns[j]
            a, b = self.begins[cell], self.ends[cell]
            if a < b and low[0][i] + low[1][j] <= search.most:
                taken += [a, b]
                waiting += b - a
                if waiting >= at_once:
                    scored += score()
                    waiting = 0
        return scored + (score() if taken else 0)


class _Positives:
    """The k best rows of one label, the anchor itself left out."""

    def __init__(self, anchor: int, label: int, k: int):
        self.anchor, self.label, self.k = anchor, label, k
        self.need, self.most = -np.inf, np.inf
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        own = (labels == self.label) & (ids != self.anchor) & (scores >= self.need)
        if own.any():
            self.scores, self.ids = _first(np.concatenate([self.scores, scores[own]]), np.concatenate([self.ids, ids[own]]), self.k)
            if len(self.ids) == self.k:
                self.need = int(self.scores[-1])


class _Negatives:
    """For each window of scores, the k best rows of other labels inside it."""

    def __init__(self, label: int, windows: list[tuple[int, int]], k: int):
        self.label, self.k = label, k
        self.windows = windows
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        self.needs = [low for low, _ in windows]
        self.need, self.most = min(self.needs), max(high for _, high in windows)

    def add(self, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        other = (labels != self.label) & (scores >= self.need) & (scores <= self.most)
        scores, ids = scores[other], ids[other]
        for w, (_, high) in enumerate(self.windows):
            own = (scores >= self.needs[w]) & (scores <= high)
            if own.any():
                s, i = self.found[w] = _first(np.concatenate([self.found[w][0], scores[own]]), np.concatenate([self.found[w][1], ids[own]]), self.k)
                if len(i) == self.k:
                    self.needs[w] = int(s[-1])
        self.need = min(self.needs)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _unpacked(data: bytes, d: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, d)


def _blocks(rows: DataFrame, shared, n: int, block: int, d: int) -> DataFrame:  # noqa: ANN001
    """A row for each block of at most ``block`` rows: ids, labels and vectors, sorted by cell."""

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(-1, d).astype(np.float64)
            first, second = shared.value.codes(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first * (1 << 16) + second, pa.int64())], names=["vec_id", "label", "v", "cell"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            ids, labels, v = (np.concatenate(p) for p in zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (ids, labels, v)], names=["ids", "labels", "vectors"])

        size = 0
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy() for c in ("vec_id", "label"))
            v = batch.column("v").flatten().to_numpy().reshape(-1, d)
            at = 0
            while at < len(ids):
                to = at + min(block - size, len(ids) - at)
                held.append((ids[at:to], labels[at:to], v[at:to]))
                size += to - at
                at = to
                if size == block:
                    yield out()
                    size = 0
        if held:
            yield out()

    dealt = rows.mapInArrow(cell, "vec_id long, label long, v array<bigint>, cell long").repartitionByRange(max(1, -(-n // block)), "cell", "vec_id").sortWithinPartitions("cell", "vec_id")
    return dealt.mapInArrow(packed, "ids binary, labels binary, vectors binary")


def mine(embeddings: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, words: int = 32, max_train: int = 8192, block: int = 4096, anchor_block: int = 8192) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = R.prepare(embeddings.sparkSession)
    rows = R.written(integer_rows(embeddings), "integers")
    found = None
    for d, n in rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():
        own = _mine(rows.where(F.size("v") == d), d, n, anchor_every, positives, negatives, low, words, max_train, block, anchor_block)
        found = own if found is None else found.unionByName(own)
    return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long") if found is None else found


def _mine(rows: DataFrame, d: int, n: int, anchor_every: int, positives: int, negatives: int, low: int, words: int, max_train: int, block: int, anchor_block: int) -> DataFrame:
    spark = rows.sparkSession
    part = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))
    picked = rows if n <= max_train else rows.where(part < int(max_train / n * (1 << 20)) + 1)
    sample = np.array([r.v for r in picked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_train).collect()], np.float64)
    shared = spark.sparkContext.broadcast(Halves.fit(sample, words))
    blocks = R.written(_blocks(rows, shared, n, block, d), "cells")
    anchors = rows.where(F.col("vec_id") % anchor_every == 0)
    parts = max(1, -(-n // (anchor_every * anchor_block)))

    def met(asked: DataFrame) -> DataFrame:
        """Every block of cells beside every block of anchors."""
        grouped = asked.repartition(parts, "vec_id").withColumn("q", F.spark_partition_id()).groupBy("q").agg(F.collect_list(F.struct(*asked.columns)).alias("anchors"))
        numbered = blocks.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return numbered.join(grouped, "q").drop("q").repartition(max(2, parts * -(-n // block)))

    def answered(run):  # noqa: ANN001, ANN202
        """Builds the cells of each row and asks ``run`` for each anchor's answers."""

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    ids, labels = (np.frombuffer(batch.column(c)[r].as_py(), np.int64) for c in ("ids", "labels"))
                    cells = Cells(shared.value, ids, labels, _unpacked(batch.column("vectors")[r].as_py(), d))
                    yield run(cells, batch.column("anchors")[r].values)

        return over

    def nearest(cells: Cells, asked: pa.StructArray) -> pa.RecordBatch:
        out = []
        for anchor, label, v in zip(*(asked.field(c).to_pylist() for c in ("vec_id", "label", "v")), strict=True):
            search = _Positives(anchor, label, positives)
            cells.visit(np.array(v, np.int64), search)
            out += [(anchor, i, s) for i, s in zip(search.ids.tolist(), search.scores.tolist(), strict=True)]
        return _batch(out, ["anchor_id", "positive_id", "score"])

    best = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
    near = met(anchors).mapInArrow(answered(nearest), "anchor_id long, positive_id long, score long")
    near = R.written(near.withColumn("place", best).where(F.col("place") <= positives).drop("place"), "positives")
    windows = near.where(F.col("score") >= 0).groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "score")).alias("windows"))
    asked = anchors.join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id")

    def hard(cells: Cells, asked: pa.StructArray) -> pa.RecordBatch:
        out = []
        for anchor, label, v, own in zip(*(asked.field(c).to_pylist() for c in ("vec_id", "label", "v", "windows")), strict=True):
            search = _Negatives(label, [(-((-low * w["score"]) // 100), w["score"]) for w in own], negatives)
            cells.visit(np.array(v, np.int64), search)
            for w, (scores, ids) in zip(own, search.found, strict=True):
                out += [(anchor, w["positive_id"], w["score"], i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        return _batch(out, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    found = met(asked).mapInArrow(answered(hard), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)


def brute_force(rows: pd.DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 5) -> list[tuple]:
    """The answer on a small table (vec_id, label, embedding), for tests."""
    import math

    kept = {}
    for r in sorted(rows.itertuples(), key=lambda r: str(r.vec_id)):
        x = r.embedding
        if pd.isna(r.vec_id) or pd.isna(r.label) or x is None or not len(x) or any(c is None or not math.isfinite(c) for c in x):
            continue
        label = int(r.label)
        label = (label + 1) % 10 if r.vec_id % 7 == 0 else label
        new = (label, [math.floor(256 * float(c)) for c in x])
        kept[int(r.vec_id)] = min(kept.get(int(r.vec_id), new), new)
    out = []
    for a, (label, q) in kept.items():
        if a % anchor_every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, other) for i, (other, v) in kept.items() if i != a and len(v) == len(q))
        for ps, p, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [s for s in scored if s[2] != label and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:negatives]
            out += [(a, p, k + 1, s[1], -ps, -s[0]) for k, s in enumerate(inside)]
    return sorted(out)
