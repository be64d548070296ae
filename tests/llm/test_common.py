import random

import numpy as np

from groundeval.llm import common


def test_word_hashes_follow_the_words():
    rng = random.Random(0)
    hasher = common.WordHasher()
    seen = {}
    alphabet = "abé\U0001f600.\x00 \t\n\x0b\x0c\r \x85"
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60))).encode()
        words = text.split()
        h = hasher(text)
        assert len(h) == len(words)
        for w, x in zip(words, h.tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    assert len(hasher(b"")) == 0 and len(hasher(b" \n")) == 0


def test_word_hashes_of_long_texts(monkeypatch):
    text = " ".join(f"w{i * 7919 % 500}" + "x" * (i % 90) for i in range(3000)).encode()
    whole = common.WordHasher()(text)
    monkeypatch.setattr(common, "_PIECE", 1000)
    assert (common.WordHasher()(text) == whole).all()
    assert len(np.unique(whole)) == len(set(text.split()))


def test_word_table_forgets_nothing():
    table = common.WordTable(len, limit=3)
    assert [table[w] for w in ("a", "bb", "ccc", "dddd", "a", "bb")] == [1, 2, 3, 4, 1, 2]
    assert len(table) <= 3
