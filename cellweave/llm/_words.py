"""Vectorised words, word hashes and shingle hashes over an Arrow batch's byte buffer.

No per-word Python code runs: words are runs of bytes of a class, a word's hash is a
difference of prefix sums of a polynomial modulo 2**64, a shingle's hash a polynomial over
the hashes of its words.  Hashes find candidates or stand in for words in 64 or 128 bits.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class ByteClass:
    """Which bytes are part of a word, and what each byte counts as (A-Z lower-cased or not)."""

    def __init__(self, in_word: np.ndarray, lower: bool):
        self.in_word = in_word
        self.fold = np.arange(256, dtype=np.uint8)
        if lower:
            self.fold[65:91] += 32


def _space_words() -> np.ndarray:
    in_word = np.ones(256, bool)
    in_word[[0x20, *range(0x09, 0x0E)]] = False
    return in_word


def _alnum_words() -> np.ndarray:
    in_word = np.zeros(256, bool)
    in_word[0x30:0x3A] = in_word[0x41:0x5B] = in_word[0x61:0x7B] = in_word[0x80:] = True
    return in_word


#: [^\x20\x09-\x0D]+, unchanged and lower-cased; [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
SPACE_EXACT = ByteClass(_space_words(), False)
SPACE_LOWER = ByteClass(_space_words(), True)
ALNUM_LOWER = ByteClass(_alnum_words(), True)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        self.base = int(rng.integers(1 << 61, 1 << 62)) * 2 + 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def grown(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(n - 1, 1).bit_length()
            out = []
            for base in (self.base, self.inverse):
                a = np.ones(size, np.uint64)
                done = 1
                while done < size:  # doubling: a[k+done] = a[k] * base**done
                    a[done : 2 * done] = a[: min(done, size - done)] * _U(pow(base, done, 1 << 64))
                    done *= 2
                out.append(a)
            self.up, self.down = out
        return self.up, self.down


_POWERS: dict[int, _Powers] = {}


def powers(seed: int) -> _Powers:
    if seed not in _POWERS:
        _POWERS[seed] = _Powers(seed)
    return _POWERS[seed]


def words(data: np.ndarray, offsets: np.ndarray, kind: ByteClass) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, row) of each word; offsets bound the rows inside data."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    inside = kind.in_word[data[lo:hi]]
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(len(inside) + 1, bool)
    inner = offsets[:-1] - lo
    edge[inner[inner < len(edge)]] = True
    edge[-1] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(ends) + 1
    rows = np.searchsorted(offsets, starts + lo, "right") - 1
    return starts + lo, stops + lo, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, kind: ByteClass, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word's folded bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    own = powers(seed)
    lo, hi = int(starts[0]), int(stops[-1])
    up, down = own.grown(hi - lo + 1)
    sums = np.zeros(hi - lo + 1, np.uint64)
    np.cumsum(own.table[kind.fold[data[lo:hi]]] * up[: hi - lo], out=sums[1:])
    a, b = starts - lo, stops - lo
    return _mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def shingle_hashes(hashes: np.ndarray, rows: np.ndarray, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of k words of one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    base = _U(pow(0xD6E8FEB86659FD93, 2 * seed - 1, 1 << 64) | 1)
    h = hashes[:n].copy()
    for j in range(1, k):
        h *= base
        h += hashes[j : j + n]
    at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return at, _mix(h[at] + _U(k))


def sequence_hash(hashes: np.ndarray, seed: int = 1) -> int:
    """The hash of one whole run of words, as shingle_hashes has it for k = len(hashes)."""
    return int(shingle_hashes(hashes, np.zeros(len(hashes), np.int64), len(hashes), seed)[1][0])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
