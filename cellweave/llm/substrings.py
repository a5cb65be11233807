"""Substring deduplication on a compacted De Bruijn graph of words.

A window of ``window`` words is an edge of the graph.  Runs of neighbouring edges of one text
that share an anchor (the least hash among the ``anchor``-word shingles of a window) form a
path.  Equal edges have equal anchors, so everything that concerns an edge meets at its anchor:

1. Every block of texts sends each anchor once: with the hash of its path and the smallest
   document, or as branching if the block has several paths through it.
2. Per anchor, over all blocks: one path throughout is nonbranching, and the path as a whole
   is a repeat in every document but the smallest.  Several paths make a branch, and their
   documents are asked for the single edges there.
3. The edges asked for are compared one by one in the same way.
4. A text loses the words covered by its repeated edges.  Every answer names its source: a
   smaller document and the word where the path or edge starts there.  Neighbouring edges
   whose source coordinates go on side by side join into one span.
5. Each different span is compared, by SHA-256 of its words, with the words that its source
   holds at these coordinates.  Should one differ (a collision of the hashes above), nothing
   is kept of the run and all is repeated with other hash functions, so results are exact.

Spans end at multiples of 256 words of their source at the latest, so that a source is asked
for at most 128 spans for each of its words, however many documents repeat it.  Spans with
different sources may overlap.
A block combines its own repeats before anything is shuffled, so a passage in any share of
all documents sends one row for each block, and no group is ever larger than the blocks are
many.  Texts are shuffled by id twice: for the answers, and for the comparison with sources.

Order is by doc_id: a window goes if it also starts in a document with a smaller id.  Rows of
one id are one document in that respect.  A row with null id loses nothing and is no source.
A null or empty text has no words.  Very long texts are one block of their own.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _runtime as R
from . import _words as W

WINDOW, ANCHOR = 13, 6
#: Anchors that a block gathers before it is combined and sent.
_BLOCK = 1 << 20
_REMOVE, _EXPAND, _EDGE = 0, 1, 2
#: mark: a word of the source * 16 + kind.
_ANSWER = "doc bigint, code bigint, source bigint, mark bigint"
#: Words of a source after which a span ends at the latest.
_PIECE = 256
_U = np.uint64


class _Sums:
    """Prefix sums over word hashes: the hash of any run of words is one subtraction."""

    def __init__(self, hashes: np.ndarray, seed: int):
        powers = W.powers(1000 + seed)
        self.up, self.down = powers.grown(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.up[: len(hashes)], out=self.sums[1:])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return W._mix((self.sums[last] - self.sums[first]) * self.down[first] + (last - first).astype(np.uint64))


class Paths:
    """The windows of a block of texts, and the paths that their anchors make of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR, salt: int = 0):
        self.starts, self.stops, self.rows = W.words(data, offsets, W.SPACE_EXACT)
        hashes = W.word_hashes(data, self.starts, self.stops, W.SPACE_EXACT, 1 + salt)
        n = len(hashes)
        self.begin = np.searchsorted(self.rows, np.arange(len(offsets) - 1))
        self.window = window
        self.first = np.zeros(0, np.int64)  # per window: its first word
        self.path = np.zeros(0, np.int64)  # per window: its path
        self.anchors = self.codes = np.zeros(0, np.uint64)  # per path
        self.path_rows = self.path_first = self.path_at = np.zeros(0, np.int64)
        if n < window:
            return
        self.sums = [_Sums(hashes, 1 + 2 * salt), _Sums(hashes, 2 + 2 * salt)]
        at = np.arange(n - anchor + 1)
        least = self.sums[0](at, at + anchor)
        reach, width = 1, window - anchor + 1
        while reach < width:  # least over `width` shingles, by doubling
            step = min(reach, width - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        self.first = np.flatnonzero(self.rows[: n - window + 1] == self.rows[window - 1 :])
        if not len(self.first):
            return
        own, row = least[self.first], self.rows[self.first]
        new = np.r_[True, (own[1:] != own[:-1]) | (row[1:] != row[:-1]) | (np.diff(self.first) != 1)]
        self.path = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        tail = np.r_[head[1:], len(new)] - 1
        self.anchors, self.path_rows, self.path_first = own[head], row[head], self.first[head]
        self.path_at = self.within_row(self.path_first)
        self.codes = self.sums[1](self.first[head], self.first[tail] + window)

    def within_row(self, words: np.ndarray) -> np.ndarray:
        """Places of words in their rows."""
        return words - self.begin[self.rows[words]]

    def edges(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = self.first[which]
        return self.sums[0](a, a + self.window), self.sums[1](a, a + self.window)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _batch(columns: dict[str, np.ndarray], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) for c, k in kinds.items()], names=list(kinds))


_QUESTION = {"key": pa.int64(), "code": pa.int64(), "doc": pa.int64(), "mark": pa.int64()}
_QUESTION_SQL = "key bigint, code bigint, doc bigint, mark bigint"
#: Kinds of rows on the way to an anchor: one path, several paths; answers known already pass through,
#: with the document told as key and the source as doc.
_ONE, _SEVERAL, _KNOWN = 0, 1, 10


def _mark(kind: np.ndarray | int, at: np.ndarray) -> np.ndarray:
    return at.astype(np.int64) * 16 + kind


def _questions(docs: np.ndarray, anchors: np.ndarray, codes: np.ndarray, ats: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each anchor of the block, and the answers that the block knows by itself.

    The row of an anchor has the place of its path in the least document."""
    order = np.lexsort((docs, codes, anchors))
    h, s, d, at = anchors[order], codes[order], docs[order], ats[order]
    pair = _groups(h, s)
    group = _groups(h)
    n_pairs = np.diff(np.r_[np.searchsorted(pair, group), len(pair)])
    sizes = np.diff(np.r_[group, len(h)])
    least, most = np.minimum.reduceat(d, group), np.maximum.reduceat(d, group)
    several = n_pairs > 1
    yield _batch({"key": W.signed(h[group]), "code": W.signed(np.where(several, _U(0), s[group])), "doc": least, "mark": _mark(several, at[group])}, _QUESTION)
    open_ = np.repeat(several & (least != most), sizes)
    if open_.any():  # branching inside the block, between documents
        hh, dd = h[open_], d[open_]
        keep = _distinct(hh, dd)
        hh, dd = hh[keep], dd[keep]
        yield _batch({"key": dd, "code": W.signed(hh), "doc": dd, "mark": np.full(len(dd), _KNOWN + _EXPAND, np.int64)}, _QUESTION)
    pairs = np.diff(np.r_[pair, len(d)])
    lowest, place = np.repeat(d[pair], pairs), np.repeat(at[pair], pairs)
    again = d > lowest  # the same path in a smaller document of the block
    if again.any():
        ss, dd = s[again], d[again]
        keep = _distinct(ss, dd)
        yield _batch({"key": dd[keep], "code": W.signed(ss[keep]), "doc": lowest[again][keep], "mark": _mark(_KNOWN + _REMOVE, place[again][keep])}, _QUESTION)


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    order = np.lexsort((b, a))
    return order[_groups(a[order], b[order])]


def _first_pass(window: int, anchor: int, salt: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            data, offsets = R.text_buffers(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for lo, hi in R.chunks(offsets):
                paths = Paths(data, offsets[lo : hi + 1], window, anchor, salt)
                if len(paths.anchors):
                    held.append((ids[lo:hi][paths.path_rows], paths.anchors, paths.codes, paths.path_at))
                if sum(len(x[0]) for x in held) >= _BLOCK:
                    yield from _questions(*map(np.concatenate, zip(*held, strict=True)))
                    held.clear()
        if held:
            yield from _questions(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches that never split a key; a key has a row for each block at most."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


_ANSWERS = {"doc": pa.int64(), "code": pa.int64(), "source": pa.int64(), "mark": pa.int64()}


def _answer_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _whole_groups(batches):
        key, code, doc, mark = (table.column(c).to_numpy() for c in _QUESTION)
        kind, at = mark & 15, mark >> 4
        known = kind >= _KNOWN
        if known.any():
            yield _batch({"doc": key[known], "code": code[known], "source": doc[known], "mark": mark[known] - _KNOWN}, _ANSWERS)
            key, code, doc, kind, at = key[~known], code[~known], doc[~known], kind[~known], at[~known]
        if not len(key):
            continue
        group = _groups(key)
        sizes = np.diff(np.r_[group, len(key)])
        least, most = np.minimum.reduceat(doc, group), np.maximum.reduceat(doc, group)
        branch = (np.maximum.reduceat(kind, group) == _SEVERAL) | (np.minimum.reduceat(code, group) != np.maximum.reduceat(code, group))
        shared = least != most
        expand = np.repeat(branch & shared, sizes)
        lowest = np.repeat(least, sizes)
        remove = np.repeat(~branch & shared, sizes) & (doc > lowest)
        both = expand | remove
        if both.any():
            place = np.repeat(np.minimum.reduceat(np.where(doc == lowest, at, np.iinfo(np.int64).max), group), sizes)
            yield _batch({"doc": doc[both], "code": np.where(expand, key, code)[both], "source": lowest[both], "mark": _mark(np.where(expand, _EXPAND, _REMOVE)[both], place[both])}, _ANSWERS)


def _answer_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _whole_groups(batches):
        key, code, doc, mark = (table.column(c).to_numpy() for c in _QUESTION)
        kind, at = mark & 15, mark >> 4
        known = kind >= _KNOWN
        if known.any():
            yield _batch({"doc": key[known], "code": code[known], "source": doc[known], "mark": mark[known] - _KNOWN}, _ANSWERS)
            key, code, doc, at = key[~known], code[~known], doc[~known], at[~known]
        if not len(key):
            continue
        order = np.lexsort((doc, code, key))
        key, code, doc, at = key[order], code[order], doc[order], at[order]
        group = _groups(key, code)
        sizes = np.diff(np.r_[group, len(key)])
        lowest = np.repeat(doc[group], sizes)
        again = doc > lowest
        if again.any():
            yield _batch({"doc": doc[again], "code": key[again], "source": lowest[again], "mark": _mark(_EDGE, np.repeat(at[group], sizes)[again])}, _ANSWERS)


class _Told:
    """The answers of a batch of rows, as (row, code, source, place) sorted in this order, by kind."""

    def __init__(self, batch: pa.RecordBatch):
        lists = batch.column("__answers")
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        rows = np.repeat(np.arange(batch.num_rows), sizes)
        codes, sources, marks = (flat.field(c).to_numpy() for c in ("code", "source", "mark"))
        kinds, places = marks & 15, marks >> 4
        self.some = sizes > 0
        self.by = {}
        for kind in (_REMOVE, _EXPAND, _EDGE):
            own = kinds == kind
            columns = rows[own], codes[own], sources[own], places[own]
            order = np.lexsort(columns[::-1])
            self.by[kind] = tuple(x[order] for x in columns)

    def within(self, kind: int, rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Which (row, code) pairs were told."""
        return self.find(kind, rows, codes) >= 0

    def find(self, kind: int, rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The first answer of each (row, code) pair, by its place in ``by``; -1 where there is none."""
        r, c = self.by[kind][:2]
        out = np.full(len(rows), -1, np.int64)
        if not len(r) or not len(rows):
            return out
        # sort both together: equal pairs become neighbours
        n = len(r)
        allr, allc = np.r_[r, rows], np.r_[c, codes]
        asked = np.r_[np.zeros(n, bool), np.ones(len(rows), bool)]
        order = np.lexsort((asked, allc, allr))
        start = _groups(allr[order], allc[order])
        told = np.repeat(np.where(asked[order[start]], -1, order[start]), np.diff(np.r_[start, len(order)]))
        inside = order[asked[order]] - n
        out[inside] = told[asked[order]]
        return out


def _second_pass(window: int, anchor: int, salt: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def sent() -> Iterator[pa.RecordBatch]:
            docs, a, b, at = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            order = np.lexsort((docs, b, a))
            docs, a, b, at = docs[order], a[order], b[order], at[order]
            group = _groups(a, b)
            sizes = np.diff(np.r_[group, len(docs)])
            yield _batch({"key": W.signed(a[group]), "code": W.signed(b[group]), "doc": docs[group], "mark": _mark(_ONE, at[group])}, _QUESTION)
            lowest = np.repeat(docs[group], sizes)
            again = docs > lowest
            if again.any():
                aa, dd, source, place = a[again], docs[again], lowest[again], np.repeat(at[group], sizes)[again]
                keep = _distinct(aa, dd)
                yield _batch({"key": dd[keep], "code": W.signed(aa[keep]), "doc": source[keep], "mark": _mark(_KNOWN + _EDGE, place[keep])}, _QUESTION)

        for batch in batches:
            told = _Told(batch)
            data, offsets = R.text_buffers(batch.column("text"))
            ids = batch.column("doc_id")
            for lo, hi in R.chunks(offsets):
                if not told.some[lo:hi].any():
                    continue
                paths = Paths(data, offsets[lo : hi + 1], window, anchor, salt)
                asked = told.within(_EXPAND, paths.path_rows + lo, W.signed(paths.anchors))
                which = np.flatnonzero(asked[paths.path]) if len(paths.path) else paths.path
                if len(which):
                    a, b = paths.edges(which)
                    held.append((ids.slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64)[paths.path_rows[paths.path[which]]], a, b, paths.within_row(paths.first[which])))
                if sum(len(x[0]) for x in held) >= _BLOCK:
                    yield from sent()
        if held:
            yield from sent()

    return run


def _segments(paths: Paths, told: _Told, lo: int, window: int) -> tuple[np.ndarray, ...]:
    """Runs of repeated windows whose sources go on side by side: row, first word, stop, source, its word."""
    per_path = told.find(_REMOVE, paths.path_rows + lo, W.signed(paths.codes))
    found = per_path[paths.path]
    bad = np.flatnonzero(found >= 0)
    _, _, sources, places = told.by[_REMOVE]
    source, place = sources[found[bad]], places[found[bad]] + paths.first[bad] - paths.path_first[paths.path[bad]]
    if len(told.by[_EDGE][0]):
        asked = told.within(_EXPAND, paths.path_rows + lo, W.signed(paths.anchors))
        which = np.flatnonzero(asked[paths.path] & (found < 0))
        edge = told.find(_EDGE, paths.path_rows[paths.path[which]] + lo, W.signed(paths.edges(which)[0]))
        which, edge = which[edge >= 0], edge[edge >= 0]
        _, _, sources, places = told.by[_EDGE]
        bad, source, place = np.r_[bad, which], np.r_[source, sources[edge]], np.r_[place, places[edge]]
        order = np.argsort(bad, kind="stable")
        bad, source, place = bad[order], source[order], place[order]
    first = paths.first[bad]
    row = paths.rows[first]
    new = np.ones(len(bad), bool)
    new[1:] = (np.diff(first) != 1) | (np.diff(row) != 0) | (np.diff(source) != 0) | (np.diff(place) != 1) | (place[1:] % _PIECE == 0)
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(new)][: len(head)] - 1
    return row[head], first[head], first[tail] + window, source[head], place[head]


def _words_of(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> bytes:
    """Words joined by one space."""
    if not len(starts):
        return b""
    whole, base = data[starts[0] : stops[-1]].tobytes(), int(starts[0])
    if len(whole) == int((stops - starts).sum()) + len(starts) - 1 and whole.count(b" ") == len(starts) - 1:
        return whole
    return b" ".join([whole[x:y] for x, y in zip((starts - base).tolist(), (stops - base).tolist(), strict=True)])


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32()), ("sha256", pa.binary())]))
_SPANS_SQL = "array<struct<start:int,stop:int,source:bigint,source_start:int,sha256:binary>>"


def _last_pass(window: int, anchor: int, salt: int, keep: tuple[str, ...], joined: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = _Told(batch)
            data, offsets = R.text_buffers(batch.column("text"))
            texts: list[str | None] = batch.column("text").to_pylist()
            n_words, n_removed = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            kept: list[str | None] = list(texts) if not joined else [None] * batch.num_rows
            for lo, hi in R.chunks(offsets):
                if not told.some[lo:hi].any() and not joined:
                    n_words[lo:hi] = np.bincount(W.words(data, offsets[lo : hi + 1], W.SPACE_EXACT)[2], minlength=hi - lo)
                    continue
                paths = Paths(data, offsets[lo : hi + 1], window, anchor, salt)
                counts = np.bincount(paths.rows, minlength=hi - lo)
                n_words[lo:hi] = counts
                gone = np.zeros(len(paths.rows) + 1, np.int64)
                begin = np.cumsum(counts) - counts
                if len(paths.path):
                    segments = _segments(paths, told, lo, window)
                    np.add.at(gone, segments[1], 1)
                    np.add.at(gone, segments[2], -1)
                    for row, x, y, source, place in zip(*(v.tolist() for v in segments), strict=True):
                        proof = hashlib.sha256(_words_of(data, paths.starts[x:y], paths.stops[x:y])).digest()
                        a = int(begin[row])
                        spans[lo + row].append({"start": x - a, "stop": y - a, "source": source, "source_start": place, "sha256": proof})
                covered = np.cumsum(gone[:-1]) > 0
                n_removed[lo:hi] = np.bincount(paths.rows[covered], minlength=hi - lo)
                for row in range(hi - lo):
                    a, b = int(begin[row]), int(begin[row] + counts[row])
                    if n_removed[lo + row] or joined:
                        left = np.flatnonzero(~covered[a:b]) + a
                        if joined:
                            kept[lo + row] = _words_of(data, paths.starts[left], paths.stops[left]).decode()
                        else:  # what stands between kept words stays as it was
                            kept[lo + row] = _cut(data, int(offsets[lo + row]), int(offsets[lo + row + 1]), paths.starts[a:b], paths.stops[a:b], covered[a:b])
            columns = [batch.column(c) for c in keep if c != "text"]
            names = [c for c in keep if c != "text"]
            found = pa.array(spans, _SPANS)
            if joined:
                digests = [hashlib.sha256((k or "").encode()).hexdigest() for k in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words), pa.array(n_removed), pa.array(digests), found], names=[*names, "n_words", "n_removed", "kept_sha256", "spans"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()) if c == "text" else batch.column(c) for c in keep] + [pa.array(n_words), pa.array(n_removed), found], names=[*keep, "__n_words", "__n_removed", "__spans"])

    return run


def _cut(data: np.ndarray, lo: int, hi: int, starts: np.ndarray, stops: np.ndarray, covered: np.ndarray) -> str:
    """The text without its covered words and the white space after each of their runs."""
    edge = np.flatnonzero(np.diff(np.r_[0, covered.view(np.int8), 0]))
    parts, at = [], lo
    for x, y in zip(edge[::2], edge[1::2], strict=True):
        parts.append(data[at : starts[x]].tobytes())
        at = int(starts[y]) if y < len(starts) else int(stops[y - 1])
    parts.append(data[at:hi].tobytes())
    return b"".join(parts).decode().rstrip() if covered[-1:].any() else b"".join(parts).decode()


def _told(documents: DataFrame, keep: list[str], window: int, anchor: int, salt: int) -> tuple[DataFrame, DataFrame]:
    """The rows (kept columns, doc_id, text) with the answers that concern them; the table that these are read from."""
    usable = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    asked = usable.mapInArrow(_first_pass(window, anchor, salt), _QUESTION_SQL)
    at_anchors = R.written(asked.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_answer_anchors, _ANSWER), "paths")
    texts = documents.select(*[c for c in keep if c not in ("doc_id", "text")], F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    listed = F.collect_list(F.struct("code", "source", "mark")).alias("__answers")
    # a document has at most an answer for each of its windows
    first = at_anchors.groupBy(F.col("doc").alias("__doc")).agg(listed)
    # rows without an id have no answers; a key of their own keeps them from meeting in one task
    no_id = F.col("doc_id").isNull()
    texts = texts.withColumn("__key", F.when(no_id, F.xxhash64("text")).otherwise(F.col("doc_id"))).withColumn("__none", no_id)

    def told(answers: DataFrame) -> DataFrame:
        return texts.join(answers.withColumn("__of", F.lit(False)), (F.col("__key") == F.col("__doc")) & (F.col("__none") == F.col("__of")), "left")

    # both joins keep all rows of the same frame, so Spark shuffles the texts once and reads them twice
    expanded = told(first).select("doc_id", "text", _or_none("__answers")).mapInArrow(_second_pass(window, anchor, salt), _QUESTION_SQL)
    at_edges = expanded.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_answer_edges, _ANSWER)
    everything = at_anchors.unionByName(at_edges).groupBy(F.col("doc").alias("__doc")).agg(listed)
    return told(everything).select(*keep, _or_none("__answers")), at_anchors


def _or_none(column: str) -> F.Column:
    return F.coalesce(F.col(column), F.array().cast("array<struct<code:bigint,source:bigint,mark:bigint>>")).alias(column)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the spans asked of each source, those whose words it holds."""
    for batch in batches:
        data, offsets = R.text_buffers(batch.column("text"))
        ids, asked = batch.column("doc_id"), batch.column("asked")
        for lo, hi in R.chunks(offsets):
            starts, stops, rows = W.words(data, offsets[lo : hi + 1], W.SPACE_EXACT)
            begin = np.searchsorted(rows, np.arange(hi - lo + 1))
            out = []
            for row in range(hi - lo):
                a, b = int(begin[row]), int(begin[row + 1])
                source = ids[lo + row].as_py()
                for q in asked[lo + row].as_py():
                    x, y = a + q["at"], a + q["at"] + q["n"]
                    if y <= b and hashlib.sha256(_words_of(data, starts[x:y], stops[x:y])).digest() == q["sha256"]:
                        out.append((source, q["at"], q["n"], q["sha256"]))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["source", "at", "n", "sha256"])


def confirmed(documents: DataFrame, spans: DataFrame) -> bool:
    """Whether every span (column ``spans``, one list for each row) stands at its coordinates in a row of its source."""
    each = spans.select(F.explode("spans").alias("s"))
    asked = each.select(F.col("s.source").alias("source"), F.col("s.source_start").alias("at"), (F.col("s.stop") - F.col("s.start")).alias("n"), F.col("s.sha256").alias("sha256")).distinct()
    of_source = asked.groupBy("source").agg(F.collect_list(F.struct("at", "n", "sha256")).alias("asked"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    held = texts.join(of_source, F.col("doc_id") == F.col("source")).select("doc_id", "text", "asked").mapInArrow(_confirm, "source bigint, at int, n int, sha256 binary")
    return asked.join(held, ["source", "at", "n", "sha256"], "left_anti").isEmpty()


def _cut_and_confirmed(documents: DataFrame, keep: list[str], window: int, anchor: int, joined: bool) -> DataFrame:
    """The last pass over all rows, written; again with other hash functions should a span not be confirmed."""
    R.prepare(documents.sparkSession)
    for salt in itertools.count():
        told, answers = _told(documents, keep, window, anchor, salt)
        if joined:
            schema = f"doc_id long, n_words long, n_removed long, kept_sha256 string, spans {_SPANS_SQL}"
        else:
            schema = told.select(*keep).schema.add("__n_words", "long").add("__n_removed", "long").add("__spans", StructType.fromDDL(f"s {_SPANS_SQL}")["s"].dataType)
        out = R.written(told.mapInArrow(_last_pass(window, anchor, salt, tuple(keep), joined), schema), "cut")
        R.drop(answers)
        if confirmed(documents, out.select(F.col("spans" if joined else "__spans").alias("spans"))):
            return out
        R.drop(out)
    raise AssertionError


def repeated_spans(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed spans, a row per document row.

    A span has start and stop (words of the row), its source document, the word where it starts there, and
    the SHA-256 of its words joined by spaces."""
    return _cut_and_confirmed(documents, ["doc_id", "text"], window, anchor, True)


@R.names_apart
def without_repeats(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The documents with repeated spans cut from their texts; a text of nothing else goes.

    Other columns stay, but for n_chars, which follows the text."""
    keep = documents.columns
    out = _cut_and_confirmed(documents, keep, window, anchor, False)
    out = out.where((F.col("__n_removed") == 0) | (F.col("__n_removed") < F.col("__n_words"))).drop("__n_words", "__n_removed", "__spans")
    if "n_chars" in keep:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)).select(*keep)
    return out
