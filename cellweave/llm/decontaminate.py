"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item is cut into windows of ``window`` consecutive words (an item of fewer
words is one window); a window's set holds its shingles of ``shingle`` words.  Containment is
exact, so a single shingle is a sufficient prefix: the window's rarest one by document count.

1. One pass over the corpus finds every maximal run of consecutive words whose shingles all
   belong to the benchmark, and drops runs too short for any window (length bound).
2. Shingles are ordered by the number of documents with them; the windows' prefix shingles
   join the runs' shingles; the window has to lie inside the run (positional bound).
3. The words themselves are compared over the whole window, so hash collisions cannot count.

The benchmark's shingle hashes are broadcast in blocks of at most ``max_block`` (8 bytes
each); a larger benchmark takes more blocks, each a pass over the corpus.

Nulls and edge cases: a null or empty text has no words and no hits; a null or empty item has
no window; an item without id marks words but is not listed.  Repeated rows, also with one
doc_id, are judged row by row.  Extra columns are ignored.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _runtime as R
from . import _words as W

_RUN = "array<struct<first:int,words:array<string>,shingles:array<bigint>>>"
_PER_DOC = f"doc_id bigint, n_words bigint, digest binary, runs {_RUN}"
_RUN_ARROW = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.list_(pa.string())), ("shingles", pa.list_(pa.int64()))]))
_PER_DOC_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("digest", pa.binary()), ("runs", _RUN_ARROW)])


def words_of(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[str]:
    return [bytes(W.ALNUM_LOWER.fold[data[a:b]]).decode() for a, b in zip(starts, stops, strict=True)]


def benchmark_windows(benchmark: DataFrame, window: int = 10, shingle: int = 6) -> DataFrame:
    """(item_id, words, shingles): a row for each window of each item."""
    R.prepare(benchmark.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = R.text_buffers(batch.column("text"))
            ids = batch.column("item_id")
            for i in range(batch.num_rows):
                starts, stops, rows = W.words(data, offsets[i : i + 2], W.ALNUM_LOWER)
                if not len(starts):
                    continue
                text, h = words_of(data, starts, stops), W.word_hashes(data, starts, stops, W.ALNUM_LOWER)
                size = min(window, len(text))
                _, hashes = W.shingle_hashes(h, rows, min(shingle, size))
                per = size - min(shingle, size) + 1
                n = len(text) - size + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i].as_py()] * n, pa.string()),
                        pa.array([text[j : j + size] for j in range(n)], pa.list_(pa.string())),
                        pa.array([W.signed(hashes[j : j + per]) for j in range(n)], pa.list_(pa.int64())),
                    ],
                    names=["item_id", "words", "shingles"],
                )

    return benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(cut, "item_id string, words array<string>, shingles array<bigint>")


def _runs(documents: DataFrame, tables: dict[int, tuple[np.ndarray, int]]) -> DataFrame:
    """doc_id, n_words, digest of the text and runs of benchmark shingles, a row per document.

    tables: by shingle length, the sorted hashes and the least number of shingles of a window.
    """
    shared = documents.sparkSession.sparkContext.broadcast(tables)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieves = {}
        for s, (table, need) in shared.value.items():
            sieve = np.zeros(1 << 22, bool)
            sieve[table >> np.uint64(42)] = True
            sieves[s] = (table, need, sieve)
        for batch in batches:
            data, offsets = R.text_buffers(batch.column("text"))
            n_words, runs = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for lo, hi in R.chunks(offsets):
                starts, stops, rows = W.words(data, offsets[lo : hi + 1], W.ALNUM_LOWER)
                if not len(starts):
                    continue
                counts = np.bincount(rows, minlength=hi - lo)
                n_words[lo:hi] = counts
                first = np.cumsum(counts) - counts
                h = W.word_hashes(data, starts, stops, W.ALNUM_LOWER)
                for s, (table, need, sieve) in sieves.items():
                    at, hashes = W.shingle_hashes(h, rows, s)
                    maybe = np.flatnonzero(sieve[hashes >> np.uint64(42)])
                    hit = maybe[table[np.minimum(np.searchsorted(table, hashes[maybe]), len(table) - 1)] == hashes[maybe]]
                    if not len(hit):
                        continue
                    p, found = at[hit], hashes[hit]
                    cuts = np.flatnonzero((np.diff(p) != 1) | (np.diff(rows[p]) != 0)) + 1
                    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(p)], strict=True):
                        if b - a >= need:
                            i, end = int(p[a]), int(p[b - 1]) + s
                            row = int(rows[i])
                            runs[lo + row].append({"first": i - int(first[row]), "words": words_of(data, starts[i:end], stops[i:end]), "shingles": W.signed(found[a:b])})
            digests = [hashlib.sha256(data[offsets[i] : offsets[i + 1]].tobytes()).digest() if r else None for i, r in enumerate(runs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(digests, pa.binary()), pa.array(runs, _RUN_ARROW)], schema=_PER_DOC_ARROW)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, _PER_DOC)


def find_hits(documents: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 6, max_block: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """Two frames: (doc_id, n_words, digest) for each document row, digest null without candidates,
    and (digest, start, stop, items) for each distinct verified occurrence of a benchmark window."""
    spark = R.prepare(documents.sparkSession)
    windows = R.written(
        benchmark_windows(benchmark, window, shingle).groupBy("words", "shingles").agg(F.sort_array(F.collect_set("item_id")).alias("items")).withColumn("block_key", F.xxhash64("words")),
        "windows",
    )
    total = windows.agg(F.sum(F.size("shingles"))).first()[0] or 0
    blocks = max(1, -(-total // max_block))
    metas, hits = [], []
    for block in range(blocks):
        own = windows.where(F.pmod("block_key", F.lit(blocks)) == block)
        listed = own.select((F.size("words") - F.size("shingles") + 1).alias("s"), F.size("shingles").alias("need"), F.explode("shingles").alias("shingle"))
        by: dict[int, tuple[np.ndarray, int]] = {}
        frame = listed.groupBy("s", "shingle").agg(F.min("need").alias("need")).toPandas()
        for s, part in frame.groupby("s"):
            by[int(s)] = (np.sort(part["shingle"].to_numpy(np.int64).view(np.uint64)), int(part["need"].min()))
        scanned = R.written(_runs(documents, by), "runs")
        metas.append(scanned.select("doc_id", "n_words", "digest"))
        run = scanned.where(F.col("digest").isNotNull()).select("digest", F.explode("runs").alias("run"))
        # one copy of each distinct text with candidates, combined before the shuffle; with both sizes
        # the key tells runs of different shingle lengths apart
        run = run.groupBy("digest", "run.first", F.size("run.shingles").alias("n"), F.size("run.words").alias("m")).agg(F.first("run").alias("run")).select("digest", "run")
        at = run.select("digest", "run", F.posexplode("run.shingles").alias("place", "shingle"))
        rarity = at.groupBy("shingle").agg(F.count("*").alias("df"))
        cells = own.select("words", "items", F.posexplode("shingles").alias("offset", "shingle"))
        ranked = cells.join(rarity, "shingle").groupBy("words", "items").agg(F.min(F.struct("df", "offset", "shingle")).alias("p"))
        prefix = ranked.select("words", "items", "p.offset", "p.shingle")
        start = F.col("place") - F.col("offset")
        verified = (
            at.join(prefix, "shingle")
            .where((start >= 0) & (start + F.size("words") <= F.size("run.words")))
            .where(F.slice("run.words", start + 1, F.size("words")) == F.col("words"))
            .select("digest", (F.col("run.first") + start).alias("start"), (F.col("run.first") + start + F.size("words")).alias("stop"), "items")
        )
        hits.append(verified)
    found = hits[0]
    for other in hits[1:]:
        found = found.unionByName(other)
    meta = metas[0]
    if blocks > 1:  # every block scans each row; a row keeps the digest that any of them gave
        key = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        texts = found.select("digest").distinct()
        flagged = _digested(key)
        meta = flagged.join(texts.withColumn("has", F.lit(True)), "digest", "left").select("doc_id", "n_words", F.when(F.col("has"), F.col("digest")).alias("digest"))
    del spark
    return meta, found


def _digested(documents: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = R.text_buffers(batch.column("text"))
            n_words = np.zeros(batch.num_rows, np.int64)
            for lo, hi in R.chunks(offsets):
                n_words[lo:hi] = np.bincount(W.words(data, offsets[lo : hi + 1], W.ALNUM_LOWER)[2], minlength=hi - lo)
            digests = [hashlib.sha256(data[offsets[i] : offsets[i + 1]].tobytes()).digest() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(digests, pa.binary())], names=["doc_id", "n_words", "digest"])

    return documents.mapInArrow(scan, "doc_id long, n_words long, digest binary")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 6, max_block: int = 4_000_000) -> DataFrame:
    """doc_id, n_words, spans (merged [start, stop) word ranges that are hit) and items (sorted ids), a row per document row."""
    meta, found = find_hits(documents, benchmark, window, shingle, max_block)
    # a text's occurrences are at most as many as its words: runs that touch are numbered in one pass over them
    before = Window.partitionBy("digest").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("digest").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    apart = found.withColumn("new", F.coalesce((F.max("stop").over(before) < F.col("start")).cast("int"), F.lit(1)))
    islands = apart.withColumn("island", F.sum("new").over(upto)).groupBy("digest", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    spans = islands.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = F.array().cast("array<struct<start:int,stop:int>>"), F.array().cast("array<string>")
    # rows without candidates don't join: their null keys would all meet in one task
    clear = meta.where(F.col("digest").isNull()).select("doc_id", "n_words", none[0].alias("spans"), none[1].alias("items"))
    joined = meta.where(F.col("digest").isNotNull()).join(spans, "digest", "left")
    return clear.unionByName(joined.select("doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items")))


@R.names_apart
def clean(documents: DataFrame, benchmark: DataFrame, max_broadcast: int = 500_000) -> DataFrame:
    """The documents without a hit, with all their columns.  The digests of texts with hits are
    broadcast up to max_broadcast of them (32 bytes each) and joined beyond."""
    _, found = find_hits(documents, benchmark)
    bad = R.written(found.select(F.col("digest").alias("__bad")).distinct(), "bad-texts")
    if bad.count() <= max_broadcast:
        bad = F.broadcast(bad)
    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))
    return documents.withColumn("__digest", digest).join(bad, F.col("__digest") == F.col("__bad"), "left_anti").drop("__digest")
