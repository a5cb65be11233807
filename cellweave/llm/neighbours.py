"""Nearest neighbours by inner product with additive quantisation, and an exact check of all that its bounds leave open.

A vector is its length times a direction.  A direction is the sum of one codeword from each of ``codebooks``
full-dimensional codebooks, so that long vectors don't take the codewords of the others.
The codebooks come from k-means on residuals of a bounded sample (``max_train`` rows picked by
a hash of the id); every direction is encoded by beam search over the codebooks, which keeps the
``beam`` best partial sums, and its code is stored with how far the direction is from its reconstruction.

Search: each block of queries scores each block of codes by lookup tables of query-codeword
products.  Of a block, the ``rerank`` best by these scores are worked out exactly, in double precision; the k-th
best of them is a bound that every row of the answer reaches.  An exact score differs from that by the code by
at most the query's length times the vector's times the stored distance, so all other rows that may reach the bound, and no others,
are worked out too.  So nothing that is nearest is missed, whatever the vectors: where codes tell little
(copies, vectors unlike the sample), more rows are worked out.  Blocks bound a task's
memory whatever the numbers of queries and vectors; no block is skipped.

Vectors that are null or zero, or that hold null, NaN or infinite components, take no part;
nor do rows without an id.  Ties go to the smaller id.  With fewer candidates than asked for
all are returned.  Repeated rows of one id are one vector (the first by value).  Vectors are
compared with those of their own length, and each length has its own quantiser.  Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _runtime as R

#: Pairs of vectors whose products are worked out at a time.
PAIRS = 1 << 18


class Quantiser:
    """Codebooks (m, k, d) of an additive quantiser."""

    def __init__(self, codebooks: np.ndarray, beam: int = 8):
        self.codebooks = codebooks.astype(np.float32)
        self.beam = beam
        self.norms = (self.codebooks**2).sum(2)

    @classmethod
    def fit(cls, sample: np.ndarray, codebooks: int = 16, size: int = 256, rounds: int = 8, beam: int = 8, seed: int = 11) -> Quantiser:
        rng = np.random.Generator(np.random.PCG64(seed))
        residual = sample.astype(np.float32).copy()
        books = []
        for _ in range(codebooks):
            k = min(size, len(residual))
            centres = residual[rng.choice(len(residual), k, replace=False)].copy()
            for _ in range(rounds):
                own = _nearest(residual, centres)
                counts = np.bincount(own, minlength=k)
                sums = np.zeros_like(centres)
                order = np.argsort(own, kind="stable")
                filled = np.flatnonzero(counts)
                sums[filled] = np.add.reduceat(residual[order], (np.cumsum(counts) - counts)[filled], axis=0)
                centres[filled] = sums[filled] / counts[filled, None]
                empty = np.flatnonzero(counts == 0)
                centres[empty] = residual[rng.choice(len(residual), len(empty))]
            residual -= centres[_nearest(residual, centres)]
            book = np.zeros((size, residual.shape[1]), np.float32)
            book[:k] = centres
            book[k:] = centres[0]
            books.append(book)
        return cls(np.stack(books), beam)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, m) and the squared norms of the reconstructions, by beam search."""
        n, d = x.shape
        m, k, _ = self.codebooks.shape
        codes = np.zeros((n, 1, m), np.uint8 if k <= 256 else np.uint16)
        residual = x[:, None, :].astype(np.float32)
        for j in range(m):
            width = residual.shape[1]
            error = (residual**2).sum(2)[:, :, None] - 2 * (residual.reshape(-1, d) @ self.codebooks[j].T).reshape(n, width, k) + self.norms[j]
            flat = error.reshape(n, width * k)
            keep = min(self.beam, width * k)
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            from_beam, word = best // k, best % k
            codes = np.take_along_axis(codes, from_beam[:, :, None], axis=1)
            codes[:, :, j] = word
            residual = np.take_along_axis(residual, from_beam[:, :, None], axis=1) - self.codebooks[j][word]
        best = (residual**2).sum(2).argmin(1)
        pick = np.arange(n)
        made = x - residual[pick, best]
        return codes[pick, best], (made**2).sum(1)

    def errors(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far each row is from its reconstruction, with what single precision adds to a score by tables."""
        made, size = np.zeros(x.shape), np.zeros(len(x))
        for j, book in enumerate(self.codebooks.astype(np.float64)):
            made += book[codes[:, j]]
            size += np.sqrt((book**2).sum(1))[codes[:, j]]
        m, _, d = self.codebooks.shape
        return np.sqrt(((x - made) ** 2).sum(1)) * (1 + 1e-9) + size * (m + d + 4) * 1.2e-7 + 1e-9

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products (m, k, q) of every codeword with every query."""
        return np.einsum("mkd,qd->mkq", self.codebooks, queries.astype(np.float32), optimize=True)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([(x[a : a + 8192] @ centres.T - half).argmax(1) for a in range(0, len(x), 8192)])


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part, one for each id."""
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0))
    infinite = F.lit(float("inf"))
    rows = rows.where(F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < infinite)) & F.exists("vector", lambda c: c != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, lengths) of rows that aren't zero."""
    top = np.abs(x).max(1, keepdims=True)
    scaled = x / top
    length = np.sqrt((scaled**2).sum(1, keepdims=True))
    return scaled / length, (length * top)[:, 0]


def products(x: np.ndarray, y: np.ndarray, at_x: np.ndarray, at_y: np.ndarray) -> np.ndarray:
    """Inner products of pairs of columns of x and y (d, n), component by component, in order."""
    total = np.zeros(len(at_x))
    for a in range(0, len(at_x), PAIRS):
        own = slice(a, a + PAIRS)
        for u, v in zip(x, y, strict=True):
            total[own] += u[at_x[own]] * v[at_y[own]]
    return total


def best_of_block(quantiser: Quantiser, queries: np.ndarray, qids: np.ndarray, codes: np.ndarray, errors: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, score) of the k nearest of a block for some queries, exactly; a vector of the query's own id is passed over."""
    d = queries.shape[1]
    units, q_length = directions(queries)
    _, length = directions(vectors)
    tables = quantiser.tables(units)
    approx = np.zeros((len(ids), len(queries)), np.float32)
    for j in range(len(tables)):
        approx += tables[j][codes[:, j]]
    q, x = np.ascontiguousarray(queries.T), np.ascontiguousarray(vectors.T)
    other = qids[:, None] != ids[None, :]
    with np.errstate(all="ignore"):
        # lengths whose squares leave double precision bound nothing
        bounded = np.where((length > 1e-140) & (length < 1e140), length, np.nan)
        score = np.where(other, approx.T * bounded, -np.inf)
        keep = min(rerank, len(ids))
        first = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
        at_q, at_x = np.repeat(np.arange(len(queries)), keep), first.ravel()
        own = other[at_q, at_x]
        exact = np.where(own, products(q, x, at_q, at_x), -np.inf)
        least = -np.partition(-exact.reshape(len(queries), keep), k - 1, axis=1)[:, k - 1] if keep >= k else np.full(len(queries), -np.inf)
        at_q, at_x, exact = at_q[own], at_x[own], exact[own]
        bounds = least / np.where((q_length > 1e-140) & (q_length < 1e140), q_length, np.nan)
        rest = ~(score + (errors * bounded)[None, :] < bounds[:, None]) & other
        np.put_along_axis(rest, first, False, axis=1)
        columns = np.flatnonzero(rest.any(0))
        if len(columns):
            # by a matrix product first, whose rounding is bounded: what is still open is worked out in order
            made = queries @ vectors[columns].T
            slack = 4e-16 * (d + 4) * q_length[:, None] * length[columns][None, :]
            if len(columns) > k:
                low = np.where(other[:, columns], made - slack, -np.inf)
                least = np.fmax(least, -np.partition(-low, k - 1, axis=1)[:, k - 1])
            more_q, more_x = np.nonzero(rest[:, columns] & ~(made + slack < least[:, None]))
            more_x = columns[more_x]
            at_q, at_x, exact = np.r_[at_q, more_q], np.r_[at_x, more_x], np.r_[exact, products(q, x, more_q, more_x)]
    order = np.lexsort((ids[at_x], -exact, at_q))
    at_q, at_x, exact = at_q[order], at_x[order], exact[order]
    place = np.arange(len(at_q)) - np.searchsorted(at_q, at_q)
    return at_q[place < k], ids[at_x[place < k]], exact[place < k]


def _packed(x: np.ndarray) -> bytes:
    """Vectors as single precision where that is exact, else as double."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return (short if np.array_equal(short, x) else x).tobytes()


def _unpacked(data: bytes, n: int, d: int) -> np.ndarray:
    return np.frombuffer(data, np.float32 if len(data) == 4 * n * d else np.float64).reshape(n, d).astype(np.float64)


def search(embeddings: DataFrame, query_every: int = 20, k: int = 20, rerank: int = 160, max_train: int = 8192, codebooks: int = 32, beam: int = 4, query_block: int | None = None, code_block: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by query_every.

    Queries of a block (``query_block``) read each block of codes once; by default they are 1,024, and up to 8,192 where there are
    tasks enough."""
    spark = R.prepare(embeddings.sparkSession)
    rows = R.written(usable(embeddings), "vectors")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = None
    for d, n in rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").collect():
        own = _search(rows.where(F.size("vector") == d), d, n, query_every, k, rerank, max_train, codebooks, beam, query_block, code_block)
        found = own if found is None else found.unionByName(own)
    return empty if found is None else found


def _search(rows: DataFrame, d: int, n: int, query_every: int, k: int, rerank: int, max_train: int, codebooks: int, beam: int, query_block: int | None, code_block: int) -> DataFrame:
    """The search among the n vectors of one length d."""
    spark = rows.sparkSession
    part = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))
    picked = rows if n <= max_train else rows.where(part < int(max_train / n * (1 << 20)) + 1)
    sample = np.array([r.vector for r in picked.orderBy(F.xxhash64("vec_id")).limit(max_train).collect()], np.float64)
    shared = spark.sparkContext.broadcast(Quantiser.fit(directions(sample)[0], codebooks, beam=beam))

    is_query = F.col("vec_id") % query_every == 0
    n_queries, code_blocks = rows.where(is_query).count(), -(-n // code_block)
    if query_block is None:
        query_block = min(max(1024, n_queries * code_blocks // 64), 8192)
    query_blocks = max(-(-n_queries // query_block), 1)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, block = batch.column("vec_id").to_numpy(), batch.column("c").to_numpy()
            x = batch.column("vector").flatten().to_numpy().reshape(-1, d)
            for c in np.unique(block):
                of = np.flatnonzero(block == c)
                for at in range(0, len(of), 512):
                    own = of[at : at + 512]
                    units = directions(x[own])[0]
                    codes, _ = shared.value.encode(units)
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), *[pa.array([b]) for b in (ids[own].tobytes(), codes.tobytes(), shared.value.errors(units, codes).tobytes(), _packed(x[own]))]], names=["c", "ids", "data", "errors", "vectors"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, block = batch.column("vec_id").to_numpy(), batch.column("q").to_numpy()
            x = batch.column("vector").flatten().to_numpy().reshape(-1, d)
            for q in np.unique(block):
                yield pa.RecordBatch.from_arrays([pa.array([q], pa.int64()), pa.array([ids[block == q].tobytes()]), pa.array([_packed(x[block == q])])], names=["q", "ids", "vectors"])

    # blocks go by a hash of the id, whatever the number of partitions
    placed = rows.withColumn("c", F.pmod(F.xxhash64("vec_id"), F.lit(code_blocks)).cast("long")).repartition(code_blocks, "vec_id").sortWithinPartitions("c")
    codes = R.written(placed.mapInArrow(coded, "c long, ids binary, data binary, errors binary, vectors binary"), "codes")
    dealt = rows.where(is_query).withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("long"))
    queries = dealt.repartition(query_blocks, "q").mapInArrow(asked, "q long, ids binary, vectors binary")
    # every block of codes meets every block of queries: one row for each pair of blocks
    pairs = codes.groupBy("c").agg(F.collect_list(F.struct("ids", "data", "errors", "vectors")).alias("codes")).select("codes", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("q"))
    grouped = queries.groupBy("q").agg(F.collect_list(F.struct("ids", "vectors")).alias("queries"))
    met = pairs.join(grouped, "q").select("codes", "queries").repartition(max(code_blocks * query_blocks, 2))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.codebooks.shape[0]

        def together(parts: list[dict]) -> tuple[np.ndarray, np.ndarray]:
            ids = [np.frombuffer(p["ids"], np.int64) for p in parts]
            return np.concatenate(ids), np.concatenate([_unpacked(p["vectors"], len(i), d) for p, i in zip(parts, ids, strict=True)])

        for batch in batches:
            for i in range(batch.num_rows):
                code_part, query_part = batch.column("codes")[i].as_py(), batch.column("queries")[i].as_py()
                ids, x = together(code_part)
                words = np.concatenate([np.frombuffer(p["data"], np.uint8).reshape(-1, m) for p in code_part])
                errors = np.concatenate([np.frombuffer(p["errors"], np.float64) for p in code_part])
                qids, q = together(query_part)
                for a in range(0, len(q), 64):
                    for b in range(0, len(ids), code_block):
                        own = slice(b, b + code_block)
                        at, near, score = best_of_block(shared.value, q[a : a + 64], qids[a : a + 64], words[own], errors[own], x[own], ids[own], k, rerank)
                        yield pa.RecordBatch.from_arrays([pa.array(qids[a : a + 64][at]), pa.array(near), pa.array(score)], names=["query_id", "vec_id", "score"])

    ranked = met.mapInArrow(scored, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def brute_force(vectors: pd.DataFrame, query_every: int = 20, k: int = 20) -> pd.DataFrame:
    """The exact answer on a small table, for tests and for measuring recall."""
    ids = vectors["vec_id"].to_numpy()
    x = np.stack(vectors["embedding"].to_list()).astype(np.float64)
    out = []
    for i in np.flatnonzero(ids % query_every == 0):
        s = x @ x[i]
        s[i] = -np.inf
        order = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out += [(ids[i], r + 1, ids[j], s[j]) for r, j in enumerate(order)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
