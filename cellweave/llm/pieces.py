"""SentencePiece encoding and decoding with source offsets.

The model file is read directly.  ``Normalizer`` applies its compiled character map by
longest prefix (a double-array trie over UTF-8 bytes) and records, for every byte it emits,
the source byte it stands for, so that each piece projects to a span of the original text.
``Encoder`` segments the normalised text with BPE merges.  No piece of a model holds a space
mark after another character (checked when it is loaded), so merges never cross the start of
a run of marks and each such unit is segmented once and remembered, within a bound.  All of it
is done here; the sentencepiece library is only what the tests compare with.

Without a character map the alignment is the identity but for marks, so a remembered unit holds
the source bytes of its pieces beside their ids, and projecting a text is one running sum.

Pieces cover the source without gaps: piece i covers the bytes offsets[i] to offsets[i + 1].
Of a character in byte pieces the last one has its bytes and the others have none.  The end id
covers what normalisation cut from the end, mostly nothing.

A null text counts as empty.  An empty text has no piece, so only the end id.  Very long
texts are split into units as they come.  Invalid UTF-8 cannot occur in a Spark string.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _runtime as R

MARK = "▁"
_NEVER = float("inf")
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


class Normalizer:
    """Longest-prefix normalisation through a compiled character map, with source alignment."""

    def __init__(self, charsmap: bytes, add_dummy_prefix: bool, remove_extra_whitespaces: bool, escape_whitespaces: bool, user_symbols: tuple[str, ...] = ()):
        self.dummy, self.squeeze, self.escape = add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces
        self.units: list[int] = []
        self.outputs = b""
        if charsmap:
            size = struct.unpack_from("<I", charsmap)[0]
            self.units = list(struct.unpack_from(f"<{size // 4}I", charsmap, 4))
            self.outputs = charsmap[4 + size :]
        self.user = sorted((s.encode() for s in user_symbols), key=len, reverse=True)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key of the map that starts at ``at``, and its replacement."""
        units = self.units
        if not units:
            return None
        unit, found, k = units[0], None, at
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        while k < len(text):
            node ^= text[k]
            if node >= len(units):
                break
            unit = units[node]
            if (unit & 0x800000FF) != text[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            k += 1
            if unit & 0x100:
                found = (k - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.outputs.index(b"\0", found[1])
        return found[0], self.outputs[found[1] : end]

    def _chunk(self, text: bytes, at: int) -> tuple[int, bytes]:
        for symbol in self.user:
            if text.startswith(symbol, at):
                return len(symbol), symbol
        if hit := self.longest(text, at):
            return hit
        lead = text[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return n, text[at : at + n]

    def __call__(self, source: str) -> tuple[str, list[int] | None]:
        """Normalised text, and the source byte of each of its bytes and of its end.

        The alignment is None where it is the identity but for the dummy prefix and marks; then
        ``spans`` works it out from the marks alone.
        """
        if not self.units and not self.squeeze and not self.user:
            text = (" " + source) if self.dummy and source else source
            return (text.replace(" ", MARK) if self.escape else text), None
        text, out, align = source.encode(), bytearray(), []
        mark = MARK.encode() if self.escape else b" "
        at, n = 0, len(text)
        if self.squeeze:
            while at < n:
                size, piece = self._chunk(text, at)
                if piece != b" ":
                    break
                at += size
        if at >= n:
            return "", [n]
        spaced = self.squeeze
        if self.dummy:
            out += mark
            align += [at] * len(mark)
        spaced = self.squeeze
        while at < n:
            size, piece = self._chunk(text, at)
            while spaced and piece.startswith(b" "):
                piece = piece[1:]
            for b in piece:
                new = mark if b == 0x20 else bytes([b])
                out += new
                align += [at] * len(new)
            if piece:
                spaced = self.squeeze and piece.endswith(b" ")
            at += size
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :], align[-len(mark) :]
                n = align[-1] + 1 if not align else n
        return out.decode(), [*align, n]


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        x = shift = 0
        while True:
            b = data[at]
            x |= (b & 0x7F) << shift
            at += 1
            if b < 0x80:
                return x, at
            shift += 7

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Encoder:
    """BPE model of a SentencePiece file: encode to ids and source spans, decode ids."""

    def __init__(self, model: bytes, remember: int = 150_000):
        self.pieces: list[tuple[str, float, int]] = []
        normal: dict[int, int | bytes] = {}
        trainer: dict[int, int | bytes] = {}
        denormal: dict[int, int | bytes] = {}
        for number, value in _fields(model):
            if number == 1:
                part = dict(_fields(value))
                self.pieces.append((part.get(1, b"").decode(), struct.unpack("<f", part[2])[0] if 2 in part else 0.0, part.get(3, 1)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
            elif number == 5:
                denormal = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("only BPE models are supported")
        if denormal.get(2):
            raise ValueError("a model with a denormaliser isn't supported")
        if trainer.get(24):
            raise ValueError("a model with space marks as suffixes isn't supported")
        self.normalizer = Normalizer(normal.get(2, b""), bool(normal.get(3, 1)), bool(normal.get(4, 1)), bool(normal.get(5, 1)), tuple(p for p, _, t in self.pieces if t == _USER))
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (_NORMAL, _USER, _UNUSED)}
        self.cost = {p: -s for p, s, t in self.pieces if t == _NORMAL}
        if any(MARK in p.lstrip(MARK) for p, _, t in self.pieces if t in (_NORMAL, _USER)) or any(t in (_USER, _UNUSED) for _, _, t in self.pieces):
            raise ValueError("a model whose pieces cross words, or with user-defined or unused pieces, isn't supported")
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == _BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next(i for i, (_, _, t) in enumerate(self.pieces) if t == _UNKNOWN)
        self.end = int(trainer.get(42, 2))
        self.surface_unknown = trainer.get(44, " ⁇ ".encode()).decode()
        normal_form = self.normalizer
        #: Whether normalising only marks spaces, so that alignment needs no map.
        self.plain = normal_form.dummy and normal_form.escape and not normal_form.units and not normal_form.squeeze and not normal_form.user and bool(self.bytes)
        self.words: dict[str, bytes] = {}
        self.words_before: dict[str, bytes] = {}
        self.remember = remember
        self.segment = lru_cache(remember)(self.segment)

    def _merged(self, unit: str) -> list[str]:
        """The unit's pieces: the best-scored neighbouring pair merges first, the leftmost of equals."""
        if len(unit) > 48:
            return self._merged_long(unit)
        symbols, cost = list(unit), self.cost
        costs = [cost.get(a + b, _NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        while costs and (least := min(costs)) != _NEVER:
            k = costs.index(least)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del costs[k]
            if k:
                costs[k - 1] = cost.get(symbols[k - 1] + symbols[k], _NEVER)
            if k < len(costs):
                costs[k] = cost.get(symbols[k] + symbols[k + 1], _NEVER)
        return symbols

    def _merged_long(self, unit: str) -> list[str]:
        """The same with a queue, for units of any length."""
        symbols: list[str | None] = list(unit)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (c := self.cost.get(joined := symbols[a] + symbols[b])) is not None:
                heapq.heappush(queue, (c, a, b, joined))

        for k in range(n - 1):
            offer(k, k + 1)
        while queue:
            _, a, b, joined = heapq.heappop(queue)
            if symbols[a] is None or symbols[b] is None or len(symbols[a]) + len(symbols[b]) != len(joined) or after[a] != b:
                continue
            symbols[a], symbols[b] = joined, None
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in symbols if s is not None]

    def segment(self, unit: str) -> list[int]:
        out: list[int] = []
        for piece in self._merged(unit):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return out

    @staticmethod
    def units(normal: str) -> list[str]:
        """Runs of marks with the characters up to the next mark."""
        parts = normal.split(MARK)
        if MARK * 2 not in normal and not parts[0] and parts[-1]:
            return [MARK + p for p in parts[1:]]
        out, marks = ([parts[0]] if parts[0] else []), ""
        for p in parts[1:]:
            marks += MARK
            if p:
                out.append(marks + p)
                marks = ""
        if marks:
            out.append(marks)
        return out

    def encode_batch(self, texts: list[str], end: bool = True) -> list[list[int]]:
        ids, counts, _ = self.encode_offsets(texts, end)
        stop = np.cumsum(counts)
        return [ids[b - n : b].tolist() for n, b in zip(counts, stop, strict=True)]

    def encode(self, text: str, end: bool = True) -> list[int]:
        return self.encode_batch([text], end)[0]

    def encode_with_spans(self, text: str, end: bool = True) -> list[tuple[int, int, int]]:
        """(id, first source byte, byte after the last) of each piece; the end id has an empty span.
        Of a character in byte pieces the last has the span and the others an empty one at its start."""
        normal, align = self.normalizer(text)
        n = len(text.encode())
        if align is None:
            raw, align, at = normal.encode(), [], -1 if self.normalizer.dummy and text else 0
            mark, k = MARK.encode(), 0
            while k < len(raw):
                if self.normalizer.escape and raw.startswith(mark, k) and (at < 0 or text.encode()[at : at + 1] == b" "):
                    align += [max(at, 0)] * 3
                    k += 3
                else:
                    align.append(at)
                    k += 1
                at += 1
            align.append(n)
        out, k = [], 0
        for unit in self.units(normal):
            for i in self.segment(unit):
                size = 1 if i in self.byte_of else len(self.pieces[i][0].encode()) if i != self.unknown else None
                if size is None:
                    size = len(unit.encode())
                b = self.byte_of.get(i)
                if b is None or b & 0xC0 != 0x80:
                    start, more = k, 0 if b is None or b < 0x80 else 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                else:
                    more -= 1
                k += size
                out.append((i, align[start], align[start if more else k]))
        if end:
            out.append((self.end, n, n))
        return out

    def _aligned(self, unit: str) -> bytes:
        """(id, source bytes) of each piece of a unit of a plain model, as int32 pairs."""
        out: list[int] = []
        for piece in self._merged(unit):
            i = self.ids.get(piece)
            if i is not None:
                out += (i, len(piece.encode()) - 2 * piece.count(MARK))
                continue
            for c in piece:
                raw = c.encode()
                for b in raw:
                    out += (self.bytes[b], 0)
                out[-1] = 1 if c == MARK else len(raw)
        return np.array(out, np.int32).tobytes()

    def _learn(self, keys: list[str]) -> None:
        """Merges many units at once: each step merges the best pair of every unit that has one."""
        units = [key if key[0] == MARK else MARK + key for key in keys]
        sizes = np.array([len(u) for u in units], np.int64)
        width = 8
        while True:  # units of near lengths together
            own = np.flatnonzero((sizes <= width) & (sizes > (width // 2 if width > 8 else 0)))
            for at in range(0, len(own), 8192):
                part = own[at : at + 8192].tolist()
                self._learn_short([keys[i] for i in part], [units[i] for i in part], sizes[part], width)
            if width == 64:
                break
            width *= 2
        for i in np.flatnonzero(sizes > width).tolist():
            self.words[keys[i]] = self._aligned(units[i])

    def _learn_short(self, keys: list[str], units: list[str], sizes: np.ndarray, width: int) -> None:
        n, never, known = len(units), np.iinfo(np.int32).max, len(self.pieces)
        row = np.repeat(np.arange(n), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        symbol = np.full((n, width + 1), -1, np.int64)
        symbol[row, place] = self._symbols(np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64))
        alive = symbol >= 0
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        cost, made = np.full((n, width + 1), never, np.int32), np.zeros((n, width + 1), np.int64)
        pair = place + 1 < sizes[row]
        r, k = row[pair], place[pair]
        cost[r, k], made[r, k] = self._pair(symbol[r, k], symbol[r, k + 1])
        live = np.arange(n)
        while True:
            k = cost[live].argmin(1)
            open_ = cost[live, k] != never
            live, k = live[open_], k[open_]
            if not len(live):
                break
            gone = after[live, k]
            symbol[live, k] = made[live, k]
            alive[live, gone] = False
            cost[live, gone] = never
            follows = after[live, gone]
            after[live, k] = follows
            inner = follows < sizes[live]
            cost[live, k] = never
            r, k1, f = live[inner], k[inner], follows[inner]
            before[r, f] = k1
            cost[r, k1], made[r, k1] = self._pair(symbol[r, k1], symbol[r, f])
            b = before[live, k]
            r, k1, b = live[b >= 0], k[b >= 0], b[b >= 0]
            cost[r, b], made[r, b] = self._pair(symbol[r, b], symbol[r, k1])
        row, place = np.nonzero(alive)
        ids = symbol[row, place]
        flat = np.empty((len(ids), 2), np.int32)
        flat[:, 0], flat[:, 1] = ids, self._source_sizes()[np.minimum(ids, known)]
        data = flat.tobytes()
        stop = np.cumsum(np.bincount(row, minlength=n)) * 8
        odd = np.bincount(row, ids >= known, n) > 0  # with characters that have no piece
        start = 0
        for key, unit, end, bad in zip(keys, units, stop.tolist(), odd.tolist(), strict=True):
            self.words[key] = self._aligned(unit) if bad else data[start:end]
            start = end

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        """The piece of each character, or a number past all pieces that stands for it."""
        if not hasattr(self, "_chars"):
            chars = sorted((ord(p), i) for p, i in self.ids.items() if len(p) == 1)
            self._chars = np.array(chars, np.int64).reshape(-1, 2).T.copy()
        known, ids = self._chars
        at = np.minimum(np.searchsorted(known, points), len(known) - 1)
        return np.where(known[at] == points, ids[at], len(self.pieces) + points)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of the piece that two symbols merge into, and the piece."""
        if not hasattr(self, "_pairs"):

            def symbol(text: str) -> int | None:
                return self.ids.get(text, len(self.pieces) + ord(text) if len(text) == 1 else None)

            rank = {c: k for k, c in enumerate(sorted(set(self.cost.values())))}
            rows = [(symbol(p[:k]), symbol(p[k:]), rank[c], self.ids[p]) for p, c in self.cost.items() for k in range(1, len(p))]
            table = np.array([((x << 32) | y, r, i) for x, y, r, i in rows if x is not None and y is not None], np.int64).reshape(-1, 3)
            self._pairs = table[np.argsort(table[:, 0])].T.copy()
        key, rank, made = self._pairs
        asked = (a << 32) | b
        at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
        return np.where(key[at] == asked, rank[at], np.iinfo(np.int32).max).astype(np.int32), made[at]

    def _source_sizes(self) -> np.ndarray:
        """Source bytes of each piece of a plain model, a mark standing for a space."""
        if not hasattr(self, "_source_size"):
            self._source_size = np.array([len(p.encode()) - 2 * p.count(MARK) for p, _, _ in self.pieces] + [0], np.int32)
        return self._source_size

    @staticmethod
    def _keys(text: str) -> list[str]:
        """The units of a plain model's text, a single leading mark left out."""
        parts = text.split(" ")
        if "" not in parts:
            return parts
        out, marks = [], ""
        for p in parts:
            marks += MARK
            if p:
                out.append(p if len(marks) == 1 else marks + p)
                marks = ""
        if marks:
            out.append(marks)
        return out

    def encode_offsets(self, texts: list[str], end: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts, the number of each one's ids, and the offsets of all: one more for each text."""
        if not self.plain:
            each = [self.encode_with_spans(t, end) for t in texts]
            ids = np.array([x[0] for of in each for x in of], np.int32)
            offsets = [o for of in each for o in ([of[0][1]] + [x[2] for x in of] if of else [0])]
            return ids, np.array([len(of) for of in each], np.int64), np.array(offsets, np.int32)
        keys = [self._keys(t) if t and MARK not in t else [] for t in texts]
        new = []
        for key in set().union(*keys).difference(self.words):
            if (was := self.words_before.get(key)) is not None:
                self.words[key] = was
            else:
                new.append(key)
        self._learn(new)
        aligned = [b"".join(map(self.words.__getitem__, of)) for of in keys]
        for k, t in enumerate(texts):
            if MARK in t:  # marks of the source itself are longer than a space
                found = np.array([(i, b - a) for i, a, b in self.encode_with_spans(t, False)], np.int32)
                found[0, 1] += 1
                aligned[k] = found.tobytes()
        if len(self.words) > self.remember:  # what has not been met since the last time is forgotten
            self.words_before, self.words = self.words, {}
        pieces = np.array([len(x) // 8 for x in aligned], np.int64)
        both = np.frombuffer(b"".join(aligned), np.int32).reshape(-1, 2)
        counts = pieces + end
        ids, sizes = np.full(counts.sum(), self.end, np.int32), np.zeros(counts.sum(), np.int32)
        begin = np.cumsum(counts) - counts
        own = np.arange(len(both)) + np.repeat(np.arange(len(texts)) * int(end), pieces)
        ids[own], sizes[own] = both[:, 0], both[:, 1]
        sizes[begin[pieces > 0]] -= 1  # the mark before the first piece is no byte of the source
        places = np.zeros(len(ids) + len(texts), np.int64)
        places[np.arange(len(ids)) + np.repeat(np.arange(len(texts)) + 1, counts)] = sizes
        total = np.cumsum(places)
        first = begin + np.arange(len(texts))
        offsets = total - np.repeat(total[first], counts + 1)
        return ids, counts, offsets.astype(np.int32)

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """``decode`` of each text's ids, from the bytes of all pieces at once."""
        data, start, size, spaced = self._table()
        begin = np.cumsum(counts) - counts
        at, n = start[ids], size[ids]
        head = begin[counts > 0]
        if not (self.normalizer.dummy or self.normalizer.squeeze):
            head = head[:0]
        head = head[spaced[ids[head]]]
        at[head] += 1
        n[head] -= 1
        stop = np.cumsum(n)
        out = data[np.repeat(at - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)]
        ends = np.r_[0, stop][np.cumsum(counts)]
        raw = out.tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:  # ids that no text gives
            return pa.array([self.decode(ids[a : a + c].tolist()) for a, c in zip(begin, counts, strict=True)], pa.string())
        return pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.string())

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all pieces, where each starts, its length, and whether it starts with a space."""
        if not hasattr(self, "_bytes_of"):
            texts = [bytes([self.byte_of[i]]) if i in self.byte_of else (t or "").encode() for i, t in enumerate(self._texts())]
            size = np.array([len(t) for t in texts], np.int64)
            spaced = np.array([t.startswith(b" ") and i != self.unknown and i not in self.byte_of for i, t in enumerate(texts)])
            self._bytes_of = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size, spaced
        return self._bytes_of

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks become spaces, the first space of the dummy prefix goes, byte
        pieces join as UTF-8 and every byte that cannot is one replacement character."""
        parts: list[str] = []
        held = bytearray()
        text_of, byte_of, first = self._texts(), self.byte_of, self.normalizer.dummy or self.normalizer.squeeze
        for i in ids:
            b = byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                parts.append(_utf8(held))
                held, first = bytearray(), False
            t = text_of[i]
            if first and t is not None:
                if i != self.unknown:
                    t = t.removeprefix(" ")
                first = False
            if t:
                parts.append(t)
        if held:
            parts.append(_utf8(held))
        return "".join(parts)

    def _texts(self) -> list[str | None]:
        if not hasattr(self, "_text_of"):
            self._text_of = [None if t == _CONTROL else self.surface_unknown if t == _UNKNOWN else p.replace(MARK, " ") for p, _, t in self.pieces]
        return self._text_of


def _utf8(held: bytearray) -> str:
    """Bytes as UTF-8, each byte that is not part of a whole character as one U+FFFD."""
    try:
        return held.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(held):
            for size in (1, 2, 3, 4):
                try:
                    out.append(bytes(held[at : at + size]).decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_ENCODERS: dict[int, Encoder] = {}


def _loaded(model) -> Encoder:  # noqa: ANN001
    """One encoder for each Python worker and model, kept with what it has learned about units."""
    key = hash(model.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model.value)
    return _ENCODERS[key]


def encode(documents: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",), decoded: bool = True) -> DataFrame:
    """The kept columns with ids array<int>, offsets array<int> (piece i covers the source bytes from
    offsets[i] to offsets[i + 1]) and the decoded text if asked for.  Kept columns have other names
    than these.  model_path is read on the driver; the file is small and fixed."""
    spark = R.prepare(documents.sparkSession)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = documents.select(*keep, text.alias("__text"))
    parts = [*keep, "ids", "offsets"] + ["decoded"] * decoded
    schema = source.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType())).add("offsets", T.ArrayType(T.IntegerType()))
    if decoded:
        schema = schema.add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(model)
        for batch in batches:
            bounds = R.text_buffers(batch.column(len(keep)))[1]
            for lo, hi in R.chunks(bounds, 2 * R.CHUNK_BYTES):
                part = batch.slice(lo, hi - lo)
                ids, counts, offsets = coder.encode_offsets(part.column(len(keep)).to_pylist())
                columns = [*part.columns[: len(keep)], R.list_column(ids, counts, pa.int32()), R.list_column(offsets, counts + 1, pa.int32())]
                if decoded:
                    columns.append(coder.decode_batch(ids, counts))
                yield pa.RecordBatch.from_arrays(columns, names=parts)

    return source.mapInArrow(run, schema)
