"""Toxicity by a factorization machine over hashed terms.

A document's terms are its words (lower-cased) and their first 4 to 8 bytes, hashed into
2**18 buckets; a bucket counts once.  All buckets are in the model

    logit = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

whose factors learn pairs, such as an insult beside a mention of a group, that add to or take
from what the single terms weigh, and pairs of terms that tell nothing alone.  The value x_i of a
term is between LEAST and 1, larger for one that tells the labels apart (chi-square), so that
thousands of indifferent terms add little noise but none is left out.

It is fitted by full-batch Adam on the driver, on about ``max_train`` labelled rows at most and
``max_pairs`` (row, bucket) pairs of them: rows are taken in the order of a hash of the id, whole texts each, those
that no longer fit are passed over, and one of each label is always taken (a row has 2**18 pairs at most).
Rows of one id, label and text count once.

Scoring reads every whole text once and needs the model alone.  A null or empty text has no
term and gets the score of the intercept.  Rows without a usable label are not learned from;
without both labels every score is the share of label 1 (0 without labels).  Of several
labels for one id each counts.  Repeated rows are scored alike.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _runtime as R
from . import _words as W

BITS = 18
PREFIXES = (4, 5, 6, 7, 8)
#: The value of a term that tells nothing alone.
LEAST = 0.1


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) pairs, distinct and sorted, of the rows that offsets bound."""
    starts, stops, rows = W.words(data, offsets, W.ALNUM_LOWER)
    parts = [rows << BITS | (W.word_hashes(data, starts, stops, W.ALNUM_LOWER, 2) >> np.uint64(64 - BITS)).astype(np.int64)]
    for m in PREFIXES:
        some = stops - starts > m
        a = starts[some]
        h = W.word_hashes(data, a, a + m, W.ALNUM_LOWER, 3)
        parts.append(rows[some] << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64))
    both = np.concatenate(parts)
    both.sort()
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    return both >> BITS, both & ((1 << BITS) - 1)


def _starts(rows: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]][: len(rows)])


@dataclass
class Machine:
    """The fitted model, a row of ``w`` and ``v`` for each bucket, the terms' values multiplied in."""

    w0: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, rows: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        """Of n rows, from (row, bucket) pairs sorted by row."""
        out = np.full(n, self.w0)
        if len(rows):
            begin = _starts(rows)
            v = self.v[buckets]
            squares = (np.add.reduceat(v, begin) ** 2).sum(1) - np.add.reduceat((v * v).sum(1), begin)
            out[rows[begin]] += np.add.reduceat(self.w[buckets], begin) + 0.5 * squares
        return out


def fit(rows: np.ndarray, buckets: np.ndarray, labels: np.ndarray, value: np.ndarray, factors: int = 4, steps: int = 80, rate: float = 0.3, decay: float = 2e-4, weight: float = 2.0, seed: int = 7) -> Machine:
    """Full-batch Adam on the weighted logistic loss; label 1 counts ``weight`` times.  (row, bucket)
    pairs are sorted by row; value: x of each bucket."""
    n, n_terms = len(labels), len(value)
    rng = np.random.Generator(np.random.PCG64(seed))
    value = value.astype(np.float32)
    weights = [np.zeros(1, np.float32), np.zeros(n_terms, np.float32), *rng.normal(0, 0.02, (factors, n_terms)).astype(np.float32)]
    each = np.where(labels == 1, weight, 1.0)
    each = (each / each.sum()).astype(np.float32)
    begin = _starts(rows)
    own = rows[begin]
    order = np.argsort(buckets, kind="stable").astype(np.int32)
    row_of = rows.astype(np.int32, copy=False)[order]
    head = _starts(buckets[order])
    term = buckets[order[head]]
    buckets = buckets.astype(np.int32, copy=False)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in weights]

    def by_row(x: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.float32)
        if len(begin):
            out[own] = np.add.reduceat(x[buckets], begin)
        return out

    def by_term(x: np.ndarray) -> np.ndarray:
        out = np.zeros(n_terms, np.float32)
        if len(head):
            out[term] = np.add.reduceat(x[row_of], head)
        return out

    for step in range(1, steps + 1):
        w0, w, *v = weights
        logit = w0[0] + by_row(w * value)
        sums = []
        for f in v:
            x = f * value
            sums.append(by_row(x))
            logit += 0.5 * (sums[-1] ** 2 - by_row(x * x))
        g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels).astype(np.float32) * each
        total = by_term(g)
        slopes = [np.array([g.sum()], np.float32), total * value + decay * w]
        slopes += [by_term(g * s) * value - total * value * value * f + decay * f for f, s in zip(v, sums, strict=True)]
        for x, dx, (m, s) in zip(weights, slopes, state, strict=True):
            m += 0.1 * (dx - m)
            s += 0.001 * (dx * dx - s)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-9)
    return Machine(float(weights[0][0]), weights[1] * value, np.stack(weights[2:], axis=1) * value[:, None])


def values(buckets: np.ndarray, toxic: np.ndarray, labels: np.ndarray, n_terms: int = 1 << BITS) -> np.ndarray:
    """The value of each bucket: its chi-square over 12, between LEAST and 1.  toxic: the label of each pair's row."""
    b = np.count_nonzero(labels)
    a = len(labels) - b
    n1 = np.bincount(buckets[toxic == 1], minlength=n_terms)
    n0 = np.bincount(buckets[toxic == 0], minlength=n_terms)
    p = (n0 + n1) / (a + b)
    chi = (n1 - p * b) ** 2 / (p * b * (1 - p) + 1e-9) + (n0 - p * a) ** 2 / (p * a * (1 - p) + 1e-9)
    return np.clip(chi / 12, LEAST, 1)


def learn(documents: DataFrame, labels: DataFrame, max_train: int = 8_000, max_pairs: int = 6_000_000, steps: int = 80) -> Machine:
    """Fits on about max_train labelled rows at most, in the order of a hash of the id, and passes over rows
    that would make more than max_pairs terms."""
    spark = R.prepare(documents.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).cast("int")
    known = known.withColumn("place", place)
    n = known.count()
    if n > max_train:
        known = known.where(F.col("place") < int(max_train / n * (1 << 20)) + 1)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the labels picked are about max_train rows at most, so their broadcast is bounded

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = R.text_buffers(pc.utf8_lower(batch.column("text")))
            for lo, hi in R.chunks(offsets):
                rows, buckets = terms(data, offsets[lo : hi + 1])
                head = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "toxic", "place")]
                yield pa.RecordBatch.from_arrays([*head, R.list_column(buckets, np.bincount(rows, minlength=hi - lo), pa.int32())], names=["doc_id", "toxic", "place", "buckets"])

    sample = texts.join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "place", "text").mapInArrow(hashed, "doc_id long, toxic int, place int, buckets array<int>")
    sample = R.written(sample.distinct(), "toxic-sample")
    # labelled ids by place: what the driver may hold
    room, taken, seen = max_pairs, [], set()
    for row in sample.groupBy("place", "toxic").agg(F.sum(F.size("buckets")).alias("pairs")).orderBy("place", "toxic").collect():
        if row["pairs"] <= room or row["toxic"] not in seen:
            room -= row["pairs"]
            seen.add(row["toxic"])
            taken.append((row["place"], row["toxic"]))
    picked = spark.createDataFrame(taken, "place int, toxic int")  # max_train rows or so
    train = sample.join(F.broadcast(picked), ["place", "toxic"], "left_semi").select("toxic", "buckets").toArrow()
    R.drop(sample)
    y = train.column("toxic").to_numpy().astype(np.int64)
    lists = train.column("buckets").combine_chunks()
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        w0 = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        return Machine(w0, np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, 1), np.float32))
    rows = np.repeat(np.arange(len(y), dtype=np.int32), lists.value_lengths().to_numpy())
    buckets = lists.flatten().to_numpy()
    return fit(rows, buckets, y, values(buckets, y[rows], y), steps=steps)


def score(documents: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The kept columns with the model's probability of label 1 under ``name``."""
    spark = R.prepare(documents.sparkSession)
    shared = spark.sparkContext.broadcast(machine)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = "text" in keep
    source = documents.select(*keep) if own else documents.select(*keep, text.alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = R.text_buffers(pc.utf8_lower(batch.column("text" if own else len(keep))))
            scores = np.zeros(batch.num_rows)
            for lo, hi in R.chunks(offsets, R.CHUNK_BYTES // 2):
                rows, buckets = terms(data, offsets[lo : hi + 1])
                scores[lo:hi] = 1 / (1 + np.exp(-np.clip(shared.value.logits(rows, buckets, hi - lo), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores)], names=[*keep, name])

    return source.mapInArrow(run, source.select(*keep).schema.add(name, "double"))


@R.names_apart
def keep_clean(documents: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """The rows scored under the threshold, with all their columns."""
    name = "__score"
    while name in documents.columns:
        name += "_"
    return score(documents, machine, tuple(documents.columns), name).where(F.col(name) < threshold).drop(name)
