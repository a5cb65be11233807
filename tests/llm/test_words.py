import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cellweave.llm import _words as W

TEXTS = st.lists(st.text(st.sampled_from("aAbZ 9\t\n\x0b.-é漢\x00 "), max_size=30), min_size=1, max_size=6)


def _arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw) or b"", np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_and_hashes_follow_the_patterns(texts):
    data, offsets = _arrays(texts)
    for kind, pattern, lower in ((W.SPACE_EXACT, r"[^\x20\x09-\x0D]+", False), (W.SPACE_LOWER, r"[^\x20\x09-\x0D]+", True), (W.ALNUM_LOWER, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        starts, stops, rows = W.words(data, offsets, kind)
        fold = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
        want = [(i, w) for i, t in enumerate(texts) for w in re.findall(pattern, t.translate(fold) if lower else t)]
        got = [(int(r), bytes(kind.fold[data[a:b]]).decode()) for a, b, r in zip(starts, stops, rows, strict=True)]
        assert got == want
        hashes = W.word_hashes(data, starts, stops, kind)
        by_hash = {}
        for h, (_, w) in zip(hashes.tolist(), got, strict=True):
            assert by_hash.setdefault(h, w) == w
        assert len(by_hash) == len({w for _, w in got})
        at, sh = W.shingle_hashes(hashes, rows, 3)
        keys = {}
        for i, h in zip(at.tolist(), sh.tolist(), strict=True):
            assert rows[i] == rows[i + 2]
            assert keys.setdefault(h, got[i][1:] + got[i + 1][1:] + got[i + 2][1:]) == got[i][1:] + got[i + 1][1:] + got[i + 2][1:]
        assert len(at) == sum(max(0, n - 2) for n in np.bincount(rows, minlength=len(texts)))
