"""Language identification by hyperdimensional profiles.

Every letter has a random vector of -1 and 1 that follows from its code point alone.  An
n-gram binds its letters: the vector of the letter j places before the last is rotated by j
places, and all are multiplied.  A document bundles (adds) the vectors of its n-grams, a
language those of its documents, each at unit length.  The mean of the language prototypes
is taken out of both, since all languages share their commonest n-grams, and the prediction
is the language with the largest cosine; the score is that cosine, at least 0.

Documents are bundled a block at a time as (counts of n-grams) x (n-gram vectors), so the
cost is one matrix product, and whole texts of any length are read.

Learning uses at most about ``max_train`` labelled rows, picked by a hash of the row; the
rows are counted first.  Nulls: a row with null text or language is not learned from; a null
text, or one without a letter, is `und` with score 0.  With no usable row to learn from all
rows are `und`.  Repeated rows are scored alike; ties go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _runtime as R

DIMENSIONS = 1024
GRAM = 3
#: Counts in one block of the product: bounds memory at 4 bytes each.
_BLOCK = 4_000_000
_CHARS = 1 << 19

_LETTER: list[np.ndarray] = []
_VECTORS: dict[int, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else 0 (which stands for a space)."""
    if not _LETTER:
        _LETTER.append(np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), np.int32, 0x110000))
    return _LETTER[0]


def letter_vectors(points: np.ndarray, d: int) -> np.ndarray:
    out = np.empty((len(points), d), np.int8)
    for i, c in enumerate(points.tolist()):
        if (c << 16) + d not in _VECTORS:
            _VECTORS[(c << 16) + d] = np.random.Generator(np.random.PCG64([c, d])).integers(0, 2, d, dtype=np.int8) * 2 - 1
        out[i] = _VECTORS[(c << 16) + d]
    return out


def gram_vectors(grams: np.ndarray, points: np.ndarray, d: int) -> np.ndarray:
    """Bound vectors, a row for each row of grams (indexes into points)."""
    base = letter_vectors(points, d)
    rotated = [np.roll(base, grams.shape[1] - 1 - j, axis=1) for j in range(grams.shape[1])]
    out = rotated[0][grams[:, 0]].astype(np.float32)
    for j in range(1, grams.shape[1]):
        out *= rotated[j][grams[:, j]]
    return out


def bundles(texts: list[str], d: int = DIMENSIONS) -> np.ndarray:
    """The sum of the n-gram vectors of each text; zero for a text without a letter."""
    out = np.zeros((len(texts), d), np.float32)
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter((len(t) + 2 for t in lowered), np.int64, len(lowered))
    points = np.frombuffer((" " + "  ".join(lowered) + " ").encode("utf-32-le"), np.uint32)
    letters = _letters()[points]
    rows = np.repeat(np.arange(len(texts)), sizes)
    keep = letters > 0  # and one space between words, before the first and after the last
    keep[:-1] |= letters[1:] > 0
    keep[1:] |= letters[:-1] > 0
    letters, rows = letters[keep], rows[keep]
    again = np.zeros(len(letters), bool)
    again[1:] = (letters[1:] == 0) & (letters[:-1] == 0) & (rows[1:] == rows[:-1])
    letters, rows = letters[~again], rows[~again]
    if len(letters) < GRAM:
        return out
    used = np.flatnonzero(np.bincount(letters, minlength=1))
    place = np.zeros(int(used[-1]) + 1, np.int64)
    place[used] = np.arange(len(used))
    code, k = place[letters], len(used)
    n = len(code) - GRAM + 1
    gram = np.zeros(n, np.int64)
    for j in range(GRAM):
        gram = gram * k + code[j : j + n]
    ok = rows[:n] == rows[GRAM - 1 :]
    gram, rows = gram[ok], rows[:n][ok]
    if not len(gram):
        return out
    if k**GRAM <= 4_000_000:
        present = np.flatnonzero(np.bincount(gram, minlength=1))
        column = np.zeros(int(present[-1]) + 1, np.int64)
        column[present] = np.arange(len(present))
        gram = column[gram]
    else:
        present, gram = np.unique(gram, return_inverse=True)
    digits = np.stack([present // k ** (GRAM - 1 - j) % k for j in range(GRAM)], axis=1)
    step = 8192  # n-grams at a time, for scripts with many letters
    for lo in range(0, len(present), step):
        vectors = gram_vectors(digits[lo : lo + step], used, d)
        width = len(vectors)
        part = slice(None) if len(present) <= step else (gram >= lo) & (gram < lo + step)
        g, r = gram[part] - lo, rows[part]
        high = max(1, _BLOCK // width)
        for a in range(0, len(texts), high):
            b = min(a + high, len(texts))
            i, j = np.searchsorted(r, [a, b])
            counts = np.bincount((r[i:j] - a) * width + g[i:j], minlength=(b - a) * width).reshape(b - a, width)
            out[a:b] += counts.astype(np.float32) @ vectors
    return out


def _pieces_of(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (end == at or n + len(texts[end]) <= _CHARS):
            n += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class Profiles:
    """Language names, the mean of their prototypes and the prototypes without it, at unit length."""

    def __init__(self, names: list[str], prototypes: np.ndarray):
        order = np.argsort(names)
        self.names = [names[i] for i in order]
        unit = _unit(np.asarray(prototypes, np.float32)[order])
        self.mean = unit.mean(axis=0) if len(names) > 1 else np.zeros(unit.shape[1], np.float32)
        self.unit = _unit(unit - self.mean)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names: list[str] = []
        scores = np.zeros(len(texts))
        for at, part in _pieces_of(texts):
            got = bundles(part, self.mean.shape[0])
            some = got.any(axis=1)
            cosine = _unit(_unit(got) - self.mean) @ self.unit.T
            best = cosine.argmax(axis=1)
            scores[at : at + len(part)] = np.where(some, np.clip(cosine[np.arange(len(part)), best], 0, 1), 0)
            names += [self.names[b] if s else "und" for b, s in zip(best, some, strict=True)]
        return names, scores


def learn(documents: DataFrame, max_train: int = 20_000, d: int = DIMENSIONS) -> Profiles | None:
    """Prototypes from text and lang of about max_train rows at most, whatever the input's size."""
    R.prepare(documents.sparkSession)
    rows = documents.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("string").alias("id")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = rows.select("lang").count()
    if not n:
        return None
    part = F.pmod(F.xxhash64("id", "lang"), F.lit(1 << 20))
    picked = rows if n <= max_train else rows.where(part < int(max_train / n * (1 << 20)) + 1)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for at, part in _pieces_of(texts):
                got = _unit(bundles(part, d)).astype(np.float64)
                own = langs[at : at + len(part)]
                for name in set(own):
                    sums[name] = sums.get(name, 0) + got[own == name].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([*map(list, sums.values())], pa.list_(pa.float64()))], names=["lang", "sums"])

    sums = picked.select("text", "lang").mapInArrow(bundle, "lang string, sums array<double>")

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "sums": [np.sum(np.stack(part["sums"].to_list()), axis=0)]})

    found = sums.groupBy("lang").applyInPandas(add, "lang string, sums array<double>").collect()  # a row for each language
    found = [r for r in found if np.any(r.sums)]
    return Profiles([r.lang for r in found], np.array([r.sums for r in found])) if found else None


def identify(documents: DataFrame, profiles: Profiles | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score."""
    spark = R.prepare(documents.sparkSession)
    source = documents.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    if profiles is None:
        return source.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(profiles)
    schema = source.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names, scores = shared.value.predict(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    return source.mapInArrow(run, schema)
