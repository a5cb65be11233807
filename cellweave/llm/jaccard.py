"""Exact Jaccard join of word shingles in metric space, by regions around pivots.

Distance is 1 - Jaccard similarity, a metric; documents are linked within a radius of it.

1. Equal sets are one class, so groups of copies never meet as pairs.
2. Whole documents are at distance 1 from almost all others, so no set of documents could part
   the whole corpus.  The pivots of the first level are single shingles: a class is replicated
   into the regions of its first n - ceil(t n) + 1 shingles in one order, frequent ones (counted
   over all documents) last.  Two linked classes meet in a number of these regions that follows
   from their sizes.  A region of few classes gives pairs, which part here if they met too rarely.
3. Every larger region takes a class for its pivot, the one that most large regions hold; regions
   with the same pivot are one cell.  What met in a large region meets in its cell.
4. A cell of too many classes for one task is parted by Voronoi: each class measures its distance
   to a fixed number of pivots and is at home with the nearest.  It visits the region of a pivot
   where d(x, p) <= d(x, nearest) + 2 r, outside of which the triangle inequality leaves nothing
   near it.  Homes meet homes and visitors, so every pair meets once.  Regions are parted again
   until they are small; one that parting does not shrink (copies of one text, all near
   each other) is dealt into tiles instead, by size and hash, and two tiles meet in one task.
5. Sets are compared whole.  A pair that shares several cells counts in the least of them.

Tasks emit numbers of links and a spanning forest of them, never all pairs of a group; ``linked``
emits every link.

A null or empty text, or one without words, has no shingle and is linked with nothing.  A text
of fewer words than a shingle is one shingle.  Shingles are 64-bit hashes and classes 64-bit
sums of them.  A row with null id takes part and shares its class's component, the least id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _runtime as R
from . import _words as W
from .components import components
from .substrings import _groups

WORDS = 5
#: Regions of a shingle up to this many classes give pairs; of more members a block sends one.
_SMALL, _BLOCK_SMALL = 8, 4
_BLOCK = 1 << 19
_CUT = np.uint64(24)
#: Cells of more classes are parted, by so many pivots, in tasks of so many classes.
_REGION, _PIVOTS, _BLOCK_CLASSES = 1024, 16, 2048
#: Classes of a tile, and the shingles it may hold if they are long.
_TILE, _TILE_SHINGLES = 512, 1 << 19


def _sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of every shingle; not distinct."""
    starts, stops, rows = W.words(data, offsets, W.SPACE_LOWER)
    h = W.word_hashes(data, starts, stops, W.SPACE_LOWER)
    at, s = W.shingle_hashes(h, rows, words)
    row = rows[at]
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        begin = np.cumsum(counts) - counts
        extra = [W.sequence_hash(h[begin[i] : begin[i] + counts[i]]) for i in short]
        row, s = np.r_[row, short], np.r_[s, np.array(extra, np.uint64)]
    return row, s


def _distinct_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    row, s = _sets(data, offsets, words)
    order = np.lexsort((s, row))
    row, s = row[order], s[order]
    first = _groups(row, s)
    return row[first], s[first]


def frequent(documents: DataFrame, words: int = WORDS, least: int = _SMALL, at_most: int = 1 << 21) -> DataFrame:
    """(shingle >> 24, count) of shingles in ``least`` documents or more, over all documents.

    Blocks send their sorted, difference-coded hashes, about 3 bytes for each shingle.  The
    at_most most frequent are returned: they only order the shingles, so that leaving some
    out costs time and changes no result."""
    n = documents.count()
    buckets = max(16, -(-n // 2000))

    def send(block: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = np.sort(np.concatenate(block) >> _CUT)
        bucket = (x * np.uint64(buckets)) >> np.uint64(40) if buckets < 1 << 23 else x % np.uint64(buckets)
        first = _groups(bucket)
        blobs = []
        for a, b in zip(first, np.r_[first[1:], len(x)], strict=True):
            steps = np.diff(x[a:b], prepend=np.uint64(0))
            blobs.append(zlib.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int64)), pa.array(blobs, pa.binary())], names=["key", "blob"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[np.ndarray] = []
        for batch in batches:
            data, offsets = R.text_buffers(batch.column("text"))
            for lo, hi in R.chunks(offsets):
                block.append(_distinct_sets(data, offsets[lo : hi + 1], words)[1])
                if sum(map(len, block)) >= _BLOCK:
                    yield from send(block)
                    block = []
        if any(map(len, block)):
            yield from send(block)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def counted() -> pa.RecordBatch:
            x, c = np.unique(np.concatenate(held), return_counts=True)
            own = c >= least
            return pa.RecordBatch.from_arrays([pa.array(x[own].view(np.int64)), pa.array(c[own])], names=["cut", "count"])

        for batch in batches:
            for k, blob in zip(batch.column("key").to_pylist(), batch.column("blob"), strict=True):
                if k != key and held:
                    yield counted()
                    held = []
                key = k
                raw = np.frombuffer(zlib.decompress(blob.as_py()), np.uint8).reshape(8, -1).T
                held.append(np.cumsum(np.ascontiguousarray(raw).view(np.uint64).ravel()))
        if held:
            yield counted()

    blobs = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "key long, blob binary")
    found = R.written(blobs.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(total, "cut long, count long"), "frequent")
    # the least count that leaves at_most of them, from a histogram of a few hundred classes of counts
    step = F.floor(F.log2("count") * 8).cast("int")
    left, least_step = at_most, 0
    for row in found.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        left -= row["n"]
        if left < 0:
            least_step = row["step"] + 1
            break
    return found.where(step >= least_step)


#: Rows that regions gather: members, pairs, members of large regions, and documents (with the
#: two halves of their text's hash).
_ROW = {"key": pa.int64(), "kind": pa.int32(), "x": pa.int64(), "n": pa.int32(), "y": pa.int64(), "m": pa.int32(), "met": pa.int32()}
_ROW_SQL = "key bigint, kind int, x bigint, n int, y bigint, m int, met int"
_MEMBER, _PAIR, _LARGE, _DOCUMENT = 0, 1, 2, 9


def _rows(kind: int, key: np.ndarray, x: np.ndarray, n: np.ndarray, y: np.ndarray | None = None, m: np.ndarray | None = None, met: np.ndarray | None = None) -> pa.RecordBatch:
    zero = np.zeros(len(x), np.int64)
    own = {"key": key, "kind": np.full(len(x), kind, np.int32), "x": x, "n": n.astype(np.int32), "y": zero if y is None else y, "m": (zero if m is None else m).astype(np.int32), "met": (zero if met is None else met).astype(np.int32)}
    return pa.RecordBatch.from_arrays([pa.array(own[c], k) for c, k in _ROW.items()], names=list(_ROW))


def _near_sizes(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m).astype(np.int64) >= percent * np.maximum(n, m).astype(np.int64)


def _all_pairs(group: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j inside groups of at most a few rows."""
    left, right = [], []
    for step in range(1, int(sizes.max(initial=1))):
        a = np.repeat(group, np.maximum(sizes - step, 0))
        inside = np.arange(len(a)) - np.repeat(np.cumsum(np.maximum(sizes - step, 0)) - np.maximum(sizes - step, 0), np.maximum(sizes - step, 0))
        left.append(a + inside)
        right.append(a + inside + step)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _counted_pairs(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    """Each pair once, with the number of regions where it met."""
    order = np.lexsort((y, x))
    group = _groups(x[order], y[order])
    first = order[group]
    return _rows(_PAIR, x[first], x[first], n[first], y[first], m[first], np.diff(np.r_[group, len(order)]))


def regions(documents: DataFrame, hot: tuple[np.ndarray, np.ndarray], words: int = WORDS, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cls) of every row, and the rows that regions gather."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(hot)

    def send(block: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, x, n = map(np.concatenate, zip(*block, strict=True))
        order = np.lexsort((x, key))
        key, x, n = key[order], x[order], n[order]
        first = _groups(key, x)
        key, x, n = key[first], x[first], n[first]
        group = _groups(key)
        sizes = np.diff(np.r_[group, len(key)])
        many = np.repeat(sizes > _BLOCK_SMALL, sizes)
        sent = ~many
        sent[group] = True  # one of a larger group, marked
        yield _rows(_MEMBER, key[sent], x[sent], n[sent], m=many[sent].astype(np.int64))
        if many.any():
            yield _rows(_LARGE, key[many], x[many], n[many], key[many])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, counts = shared.value
        sieve = np.zeros(1 << 22, bool)
        sieve[cuts >> np.uint64(18)] = True
        block: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            data, offsets = R.text_buffers(batch.column("text"))
            ids = batch.column("doc_id")
            for lo, hi in R.chunks(offsets):
                row, s = _sets(data, offsets[lo : hi + 1], words)
                times = np.zeros(len(s), np.int64)
                if len(cuts):
                    cut = s >> _CUT
                    maybe = np.flatnonzero(sieve[cut >> np.uint64(18)])
                    place = np.minimum(np.searchsorted(cuts, cut[maybe]), len(cuts) - 1)
                    is_hot = cuts[place] == cut[maybe]
                    times[maybe[is_hot]] = counts[place[is_hot]]
                order = np.lexsort((s, times, row))
                row, s = row[order], s[order]
                first = _groups(row, s)
                row, s = row[first], s[first]
                n = np.bincount(row, minlength=hi - lo)
                begin = np.cumsum(n) - n
                cls = _classes(s, n)
                half = [batch.column(c).slice(lo, hi - lo) for c in ("low", "high")]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(hi - lo, np.int64)), pa.array(np.full(hi - lo, _DOCUMENT, np.int32)), pa.array(cls), pa.array(n.astype(np.int32)), ids.slice(lo, hi - lo), *half], names=list(_ROW))
                prefix = n - -(-percent * n // 100) + 1
                inside = np.arange(len(row)) - begin[row] < prefix[row]
                r = row[inside]
                block.append((W.signed(s[inside]), cls[r], n[r]))
                if sum(len(b[0]) for b in block) >= _BLOCK // 2:
                    yield from send(block)
                    block = []
        if block:
            yield from send(block)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .substrings import _whole_groups

        for table in _whole_groups(batches):
            kind = table.column("kind").to_numpy()
            member = kind == _MEMBER
            if not member.all():
                yield from table.filter(pa.array(~member)).to_batches()
            key, x, n, marked = (table.column(c).to_numpy()[member] for c in ("key", "x", "n", "m"))
            if not len(key):
                continue
            order = np.lexsort((-marked, x, key))
            key, x, n, marked = key[order], x[order], n[order], marked[order]
            first = _groups(key, x)
            key, x, n, marked = key[first], x[first], n[first], marked[first]
            group = _groups(key)
            sizes = np.diff(np.r_[group, len(key)])
            # a region that a block found large is large
            marked = np.maximum.reduceat(marked, group) > 0
            few = (sizes > 1) & (sizes <= _SMALL) & ~marked
            i, j = _all_pairs(group[few], sizes[few])
            near = _near_sizes(n[i], n[j], percent)
            i, j = i[near], j[near]
            if len(i):
                yield _counted_pairs(x[i], n[i], x[j], n[j])
            large = np.repeat((sizes > 1) & ~few, sizes)
            if large.any():
                yield _rows(_LARGE, key[large], x[large], n[large], key[large])

    digest = _digest()
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), digest.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("low"), F.shiftright(digest, 32).cast("int").alias("high"))
    low = F.when(F.col("low") >= 1 << 31, F.col("low") - (1 << 32)).otherwise(F.col("low")).cast("int")
    sent = source.withColumn("low", low).mapInArrow(scan, _ROW_SQL)
    # rows that only pass through (documents, members of large regions) go anywhere
    key = F.when(F.col("kind") == _MEMBER, F.col("key")).otherwise(F.xxhash64("kind", "x", "y"))
    gathered = R.written(sent.withColumn("key", key).repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(gather, _ROW_SQL), "regions")
    halves = F.shiftleft(F.col("met").cast("long"), 32).bitwiseOR(F.col("m").cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return gathered.where(f"kind = {_DOCUMENT}").select(F.col("y").alias("doc_id"), "n", F.col("x").alias("cls"), halves.alias("digest")), gathered


def _digest() -> F.Column:
    return F.xxhash64(F.col("text").cast("string"))


def _classes(shingles: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class of each set, from distinct shingles row by row."""
    cls = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        cls[some] = np.add.reduceat(W._mix(shingles + np.uint64(0xA0761D6478BD642F)), (np.cumsum(n) - n)[some])
    return W.signed(W._mix(cls + n.astype(np.uint64)))


def _sets_of(needed: DataFrame, classes: DataFrame, documents: DataFrame, words: int) -> DataFrame:
    """(cls, shingles) of the needed classes, the whole sets, each from one row's text."""
    chosen = R.written(needed.join(classes, "cls").select("cls", F.col("doc_id").alias("__doc"), F.col("digest").alias("__digest")), "needed")
    if chosen.count() <= 500_000:
        chosen = F.broadcast(chosen)  # 24 bytes each
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("__doc")) & (_digest() == F.col("__digest"))).select("cls", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = R.text_buffers(batch.column("text"))
            for lo, hi in R.chunks(offsets):
                row, s = _distinct_sets(data, offsets[lo : hi + 1], words)
                n = np.bincount(row, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column("cls").slice(lo, hi - lo), R.list_column(W.signed(s), n, pa.int64())], names=["cls", "shingles"])

    # a row may be there several times
    got = texts.mapInArrow(sets, "cls bigint, shingles array<bigint>").groupBy("cls").agg(F.first("shingles").alias("shingles"))
    return R.written(got, "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of (x, y), from the whole sets."""
    a = pairs.join(sets.select(F.col("cls").alias("x"), F.col("shingles").alias("s")), "x")
    b = a.join(sets.select(F.col("cls").alias("y"), F.col("shingles").alias("t")), "y").select("x", "y", "s", "t")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.zeros(batch.num_rows, bool)
            s, t = batch.column("s"), batch.column("t")
            for i in range(batch.num_rows):
                one, other = np.asarray(s[i].values), np.asarray(t[i].values)
                both = len(np.intersect1d(one, other, assume_unique=True))
                own[i] = 100 * both >= percent * (len(one) + len(other) - both)
            yield batch.select(["x", "y"]).filter(pa.array(own))

    return b.mapInArrow(near, "x bigint, y bigint")


def _both(values: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets left with those right (row numbers), from flat sets and their sizes."""
    row = np.repeat(np.arange(len(n)), n)
    order = np.argsort(values, kind="stable")
    row, values = row[order], values[order]
    first = _groups(values)
    times = np.diff(np.r_[first, len(values)])
    inside = np.repeat(times > 1, times)
    row, column = row[inside], np.repeat(np.arange(np.count_nonzero(times > 1)), times[times > 1])
    both = np.zeros((len(left), len(right)), np.int32)
    columns = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, columns, 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        has = np.zeros((len(n), min(4096, columns - at)), np.float32)
        has[row[a:b], column[a:b] - at] = 1
        both += (has[left] @ has[right].T).astype(np.int32)
    return both


def _cells(large: DataFrame) -> DataFrame:
    """(cell, x, n): the classes of large regions, where regions of one pivot are one cell."""
    held = large.groupBy("x").agg(F.count("*").alias("held"))
    central = large.join(held, "x").groupBy("region").agg(F.min(F.struct(-F.col("held"), F.xxhash64("x"), "x")).alias("c")).select("region", F.col("c.x").alias("cell"))
    return R.written(large.join(central, "region").select("cell", "x", "n").distinct(), "cells")


def _voronoi(level: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Regions (region, x, n, cell, home) parted by the nearest of their pivots: (parent, region, x, n,
    cell, home), and the links (x, y) to pivots."""
    counted = level.groupBy("region").agg(F.count("*").alias("c"))
    blocks = F.ceil(F.col("c") / _BLOCK_CLASSES).cast("long")
    part = level.where("home").groupBy("region", F.pmod(F.xxhash64("x"), F.lit(64)).alias("part")).agg(F.slice(F.sort_array(F.collect_set(F.struct(F.xxhash64("x", "region").alias("h"), "x"))), 1, _PIVOTS).alias("some"))
    chosen = part.groupBy("region").agg(F.slice(F.sort_array(F.flatten(F.collect_list("some"))), 1, _PIVOTS).alias("some"))
    pivots = chosen.join(counted, "region").select("region", F.posexplode("some").alias("pivot", "d"), blocks.alias("blocks"))
    pivots = pivots.select("region", F.col("d.x").alias("cls"), "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    none = F.lit(None)
    pivots = pivots.select("region", "block", "cls", "pivot", none.cast("int").alias("n"), none.cast("long").alias("cell"), none.cast("boolean").alias("home"))
    members = level.join(counted, "region").select("region", F.pmod(F.xxhash64("x"), blocks).alias("block"), F.col("x").alias("cls"), F.lit(_PIVOTS).alias("pivot"), "n", "cell", "home")
    dealt = members.unionByName(pivots).join(sets, "cls").withColumn("key", F.xxhash64("region", "block"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .substrings import _whole_groups

        for table in _whole_groups(batches):
            lists = table.column("shingles").combine_chunks()
            values, n = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            key, pivot, region = (table.column(c).to_numpy() for c in ("key", "pivot", "region"))
            stop = np.cumsum(n)
            group = _groups(key, region)
            for a, b in zip(group, np.r_[group[1:], len(key)], strict=True):
                is_pivot = pivot[a:b] < _PIVOTS
                left, right = np.flatnonzero(~is_pivot), np.flatnonzero(is_pivot)
                if not len(left):
                    continue
                size = n[a:b]
                both = _both(values[stop[a] - n[a] : stop[b - 1]], size, left, right)
                either = size[left][:, None] + size[right][None, :] - both
                distance = 1 - both / either
                nearest = distance.argmin(1)
                reach = distance <= distance.min(1)[:, None] + 2 * (1 - percent / 100) + 1e-9
                own = table.select(["region", "cls", "n", "cell", "home"]).slice(a, b - a).take(pa.array(left))
                home = own.column("home").to_numpy()
                # of two homes the later one visits
                place = np.arange(len(right))
                reach &= ~home[:, None] | (place[None, :] <= nearest[:, None])
                i, j = np.nonzero(reach)
                link = (100 * both.astype(np.int64) >= percent * either)[i, j]
                cls = table.column("cls").to_numpy()[a:b]
                pivots_of = cls[right][j]
                rows = own.take(pa.array(i))
                columns = [rows.column("region"), pa.array(pivots_of), rows.column("cls"), rows.column("n"), rows.column("cell"), pa.array(home[i] & (nearest[i] == j)), pa.array(link)]
                yield from pa.Table.from_arrays(columns, names=["parent", "pivot", "x", "n", "cell", "home", "link"]).combine_chunks().to_batches()

    schema = "parent bigint, pivot bigint, x bigint, n int, cell bigint, home boolean, link boolean"
    got = R.written(dealt.repartition(F.col("key")).sortWithinPartitions("key", "region").mapInArrow(measure, schema), "voronoi")
    return got.select("parent", F.xxhash64("parent", "pivot").alias("region"), "x", "n", "cell", "home"), got.where("link and x <> pivot").select("x", F.col("pivot").alias("y"))


def _parted(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Cells as regions (region, x, n, cell, home) of few classes, or of more that parting does not shrink."""
    level = cells.select(F.xxhash64("cell").alias("region"), "x", "n", "cell", F.lit(True).alias("home"))
    done: list[DataFrame] = []
    while True:
        size = level.groupBy("region").agg(F.count("*").alias("c"))
        many = R.written(size.where(F.col("c") > _REGION), "many")
        if many.isEmpty():
            return _union([*done, level])
        done.append(level.join(many, "region", "left_anti"))
        level = R.written(level.join(many.select("region"), "region"), "level")
        parts, _ = _voronoi(level, sets, percent)
        # parting goes on only where it at most doubles the rows and leaves no part of over three quarters
        shrunk = parts.groupBy("parent", "region").count().groupBy("parent").agg(F.sum("count").alias("all"), F.max("count").alias("most"))
        better = R.written(shrunk.join(many, F.col("parent") == F.col("region")).where("all <= 2 * c and 4 * most <= 3 * c").select("parent"), "better")
        done.append(level.join(better, F.col("region") == F.col("parent"), "left_anti"))
        level = R.written(parts.join(better, "parent").drop("parent"), "parts")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _tiles(regions: DataFrame, percent: int) -> DataFrame:
    """(cls, cell, home, key, side): where each class of a region meets others.  A region of few is one
    place.  Others are dealt into tiles of near sizes; tiles of homes meet tiles of homes and visitors."""
    # linked sizes are in one band or in neighbouring ones
    width = max(-np.log(max(percent, 1) / 100), 1e-3) * 1.000001
    banded = R.written(regions.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / width)), "banded")
    room = F.expr(f"greatest(1L, least({_TILE}L, {_TILE_SHINGLES}L div most))")
    tile = F.col("band") * 2 + F.col("home").cast("int")
    counts = banded.groupBy("region", "band", "home").agg(F.count("*").alias("c"), F.max("n").alias("most"))
    tiles = counts.groupBy("region").agg(F.sum("c").alias("c"), F.max("most").alias("most"), F.map_from_entries(F.collect_list(F.struct(tile, F.ceil(F.col("c") / room).cast("long")))).alias("tiles"))
    own = banded.join(R.written(tiles, "tiles"), "region")
    small = own.where(F.col("c") <= room).select(F.col("x").alias("cls"), "cell", "home", F.xxhash64("region").alias("key"), F.lit(2).alias("side"))
    crowd = own.where(F.col("c") > room).withColumn("tile", F.pmod(F.xxhash64("x"), F.try_element_at("tiles", tile)))
    band, at, home = F.col("band"), F.col("tile"), F.col("home")

    def places(step: int, homes: bool, place) -> F.Column:  # noqa: ANN001
        of = F.coalesce(F.try_element_at("tiles", (band + step) * 2 + int(homes)), F.lit(0))
        none = F.array().cast("array<struct<key:bigint,side:int>>")
        return F.when(of == 0, none).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(of - 1, F.lit(0))), place))

    def met(kind: int, first: list, second: list, side) -> F.Column:  # noqa: ANN001
        return F.struct(F.xxhash64("region", F.lit(kind), *first, *second).alias("key"), side.alias("side"))

    same = places(0, True, lambda j: met(0, [band, F.least(at, j)], [band, F.greatest(at, j)], F.when(at == j, 2).when(at < j, 0).otherwise(1)))
    above = places(1, True, lambda j: met(0, [band, at], [band + 1, j], F.lit(0)))
    below = places(-1, True, lambda j: met(0, [band - 1, j], [band, at], F.lit(1)))
    visitors = [places(step, False, lambda j, step=step: met(1, [band, at], [band + step, j], F.lit(0))) for step in (-1, 0, 1)]
    hosts = [places(step, True, lambda j, step=step: met(1, [band + step, j], [band, at], F.lit(1))) for step in (-1, 0, 1)]
    dealt = crowd.select(F.col("x").alias("cls"), "cell", "home", F.explode(F.when(home, F.concat(same, above, below, *visitors)).otherwise(F.concat(*hosts))).alias("p"))
    return small.unionByName(dealt.select("cls", "cell", "home", "p.key", "p.side"))


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes that links join: the least node that each reaches."""
    label = np.arange(size)
    while True:
        new = label.copy()
        np.minimum.at(new, left, np.where(near, label[right][None, :], size).min(1, initial=size))
        np.minimum.at(new, right, np.where(near, label[left][:, None], size).min(0, initial=size))
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(size))
    return node, label[node]


#: What a comparison gives: the number of a class's links, or a link.
_DEGREE, _LINK = 0, 1


def _compared(placed: DataFrame, sets: DataFrame, of: DataFrame, percent: int, every: bool) -> DataFrame:
    """(kind, x, y): numbers y of links of x, and links that join what all of them join (or all links)."""
    dealt = placed.join(sets, "cls").join(of, "cls")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .substrings import _whole_groups

        for table in _whole_groups(batches):
            key, side, cls, cell, home = (table.column(c).to_numpy() for c in ("key", "side", "cls", "cell", "home"))
            lists = [table.column(c).combine_chunks() for c in ("shingles", "cells")]
            (values, n), (cells, k) = ((x.flatten().to_numpy(), x.value_lengths().to_numpy().astype(np.int64)) for x in lists)
            stop, end = np.cumsum(n), np.cumsum(k)
            group = _groups(key)
            for a, b in zip(group, np.r_[group[1:], len(key)], strict=True):
                left, right = np.flatnonzero(side[a:b] != 1), np.flatnonzero(side[a:b] != 0)
                if not len(left) or not len(right) or b - a < 2:
                    continue
                size = n[a:b]
                both = _both(values[stop[a] - n[a] : stop[b - 1]], size, left, right)
                near = both.astype(np.int64) * 100 >= (size[left][:, None] + size[right][None, :] - both) * percent
                near &= home[a:b][left][:, None] | home[a:b][right][None, :]
                if (side[a:b] == 2).all():
                    near = np.triu(near, 1)
                if not near.any():
                    continue
                # what shares a lesser cell meets there
                row, own = np.repeat(np.arange(b - a), k[a:b]), cells[end[a] - k[a] : end[b - 1]]
                less = own < cell[a]
                near &= _both(own[less], np.bincount(row[less], minlength=b - a), left, right) == 0
                c = cls[a:b]
                if every:
                    i, j = np.nonzero(near)
                    x, y = c[left[i]], c[right[j]]
                    yield _links(_LINK, np.minimum(x, y), np.maximum(x, y))
                    continue
                degree = np.bincount(left, near.sum(1), b - a) + np.bincount(right, near.sum(0), b - a)
                some = np.flatnonzero(degree)
                yield _links(_DEGREE, c[some], degree[some].astype(np.int64))
                node, root = _forest(near, left, right, b - a)
                yield _links(_LINK, c[node], c[root])

    return dealt.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(compare, "kind int, x bigint, y bigint")


def _links(kind: int, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(y)], names=["kind", "x", "y"])


def _joined(documents: DataFrame, words: int, percent: int, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cls, digest) of every row, and (kind, x, y) of the classes: numbers of links and
    links that join what all of them join, or all links."""
    R.prepare(documents.sparkSession)
    listed = frequent(documents, words).toPandas()
    cuts, counts = listed["cut"].to_numpy(np.int64).view(np.uint64), listed["count"].to_numpy(np.int32)
    order = np.argsort(cuts)
    rows, gathered = regions(documents, (cuts[order], counts[order]), words, percent)
    of_class = F.min(F.struct("doc_id", "digest"))
    classes = R.written(rows.where("n > 0").groupBy("cls").agg(of_class.alias("r")).select("cls", "r.doc_id", "r.digest"), "classes")
    cells = _cells(R.written(gathered.where(f"kind = {_LARGE}").select(F.col("y").alias("region"), "x", "n").distinct(), "large"))
    of = R.written(cells.groupBy("x").agg(F.collect_list("cell").alias("cells")), "of")
    met = gathered.where(f"kind = {_PAIR}").groupBy("x", "n", "y", "m").agg(F.sum("met").alias("met")).where(_enough(percent))
    a, b = of.select("x", F.col("cells").alias("a")), of.select(F.col("x").alias("y"), F.col("cells").alias("b"))
    apart = met.join(a, "x", "left").join(b, "y", "left").where(~F.coalesce(F.arrays_overlap("a", "b"), F.lit(False)))
    pairs = R.written(apart.select("x", "y"), "pairs")
    needed = _union([pairs.select(F.col("x").alias("cls")), pairs.select(F.col("y").alias("cls")), of.select(F.col("x").alias("cls"))]).distinct()
    sets = _sets_of(needed, classes, documents, words)
    single = R.written(_verified(pairs, sets, percent), "links")
    placed = _tiles(_parted(cells, sets, percent), percent)
    found = R.written(_compared(placed, sets, of.withColumnRenamed("x", "cls"), percent, every), "compared")
    R.drop(sets, pairs)
    out = found.unionByName(single.select(F.lit(_LINK).alias("kind"), "x", "y"))
    if not every:
        for own in ("x", "y"):
            out = out.unionByName(single.select(F.lit(_DEGREE).alias("kind"), F.col(own).alias("x"), F.lit(1).cast("long").alias("y")))
    return rows, out


def _enough(percent: int) -> F.Column:
    """Pairs that met often enough.  Of linked sets of n >= m shingles at least a = ceil(t (n + m) / (1 + t))
    are shared, and no more than ceil(t n) - 1 of them can lie past n's replicated shingles, so they
    meet in a - ceil(t n) + 1 regions or more (in small ones, if they share no large one)."""
    share = F.expr(f"({percent}L * (n + m) + {99 + percent}) div {100 + percent}")
    return F.col("met") >= share - F.expr(f"({percent}L * greatest(n, m) + 99) div 100") + 1


def _roots(links: DataFrame) -> DataFrame:
    return components(links.where(f"kind = {_LINK}").select(F.col("x").alias("a"), F.col("y").alias("b")))


def linked(documents: DataFrame, words: int = WORDS, percent: int = 75) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, cls) of every row, all links between classes (x, y), x < y, and (node, root) of
    the classes with links."""
    rows, found = _joined(documents, words, percent, every=True)
    links = R.written(found.select("kind", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), "all")
    return rows.drop("digest"), links.select("x", "y"), _roots(links)


def join(documents: DataFrame, words: int = WORDS, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (links to other classes), a row per document row."""
    rows, found = _joined(documents, words, percent)
    degree = found.where(f"kind = {_DEGREE}").groupBy(F.col("x").alias("cls")).agg(F.sum("y").alias("n_links"))
    by_class = _labelled(rows, _roots(found)).join(degree, "cls", "left").select(F.col("cls").alias("__cls"), "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    some = rows.where("n > 0").join(by_class, F.col("cls") == F.col("__cls")).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links")
    none = rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return some.unionByName(none)


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(cls, component_id) of every class with shingles."""
    least = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first"))
    labelled = least.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    return labelled.join(labelled.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("cls", "component_id")


@R.names_apart
def representatives(documents: DataFrame, words: int = WORDS, percent: int = 75) -> DataFrame:
    """The rows of each component's least id, one of several with that id; rows without shingles
    or without an id all stay.  Columns stay as they are."""
    rows, found = _joined(documents, words, percent)
    least = rows.where("n > 0").join(_labelled(rows, _roots(found)), "cls").groupBy(F.col("doc_id").alias("__doc")).agg(F.min("component_id").alias("__least"))
    gone = least.where(F.col("__least") < F.col("__doc")).select("__doc")
    left = documents.join(gone, documents["doc_id"].cast("long") == gone["__doc"], "left_anti")
    repeated = R.written(least.where(F.col("__least") == F.col("__doc")).select("__doc").join(documents.groupBy(F.col("doc_id").cast("long").alias("__doc")).count().where("count > 1").select("__doc"), "__doc"), "repeated")
    if repeated.isEmpty():
        return left
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").isNull(), F.length("text").desc(), "text"))
    apart = left.join(repeated, left["doc_id"].cast("long") == repeated["__doc"], "left")
    single = apart.where(F.col("__doc").isNull())
    first = apart.where(F.col("__doc").isNotNull()).withColumn("__order", order).where((F.col("__order") == 1) | F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop("__order")
    return single.unionByName(first).drop("__doc")
