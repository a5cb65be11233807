"""Small corpora with copies, shared passages and odd rows, and brute-force answers."""

import random
import re

WORDS = [f"w{i}x{i * 7 % 13}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, n int"


def corpus(seed: int, n: int = 80, hot: int = 30):
    """Random texts, near copies, exact copies, a passage in many texts, and edge cases."""
    rng = random.Random(seed)
    base = [rng.choices(WORDS, k=rng.randint(3, 60)) for _ in range(n)]
    passage = rng.choices(WORDS, k=25)
    texts = []
    for words in base:
        r = rng.random()
        if r < 0.3 and texts:
            other = rng.choice(texts).split()
            for _ in range(rng.randint(0, 4)):
                if other:
                    other[rng.randrange(len(other))] = rng.choice(WORDS)
            words = other
        elif r < 0.6:
            at = rng.randint(0, len(words))
            words = words[:at] + passage + words[at:]
        texts.append(" ".join(words))
    long = rng.choices(WORDS, k=120)
    for _ in range(hot):  # a large group of near copies, and exact ones
        copy = list(long)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        texts.append(" ".join(copy))
    texts += [" ".join(long)] * (hot // 2) + ["", None, "   \n", "one", "one", "One", "é É", " ".join(["same"] * 40), "a" * 5000]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(3, texts[3]), (5, texts[9]), (None, texts[2]), (None, None)]  # repeated ids, no id
    return [(i, t, "en", "s", len(t or ""), 0.5, "k", 1) for i, t in rows]


def fold(text):
    return (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
