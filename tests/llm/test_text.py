"""Hashes of words and lines."""

import numpy as np

from folio.llm import _text as tx
from folio.llm.quality import measure


def thue_morse(k):
    a = "a"
    for _ in range(k):
        a += a.translate(str.maketrans("ab", "ba"))
    return a


def test_repetitive_words_differ():
    for k in range(1, 14):
        a = thue_morse(k)
        b = a.translate(str.maketrans("ab", "ba"))
        data = np.frombuffer(f"{a} {b}".encode(), np.uint8)
        h = tx.words(data, np.array([0, len(data)])).hashes
        assert len(h) == 2 and h[0] != h[1]


def test_lines_that_differ_are_not_repeats():
    a = thue_morse(11)
    b = a.translate(str.maketrans("ab", "ba"))
    for text, n in ((f"{a}\n{b}\n{a}", 1), (f"{a}\n{b}", 0)):
        data = np.frombuffer(text.encode(), np.uint8)
        assert measure(data, np.array([0, len(data)]))["n_dup_lines"].tolist() == [n]


def test_hashes_are_of_the_bytes_alone():
    rng = np.random.default_rng(3)
    seen = {}
    for _ in range(60):
        data = np.frombuffer(bytes(rng.choice(np.frombuffer(b"ab \n\xc3\xa9", np.uint8), int(rng.integers(0, 700)))), np.uint8)
        starts = rng.integers(0, len(data) + 1, 40)
        ends = np.array([int(rng.integers(s, len(data) + 1)) for s in starts])
        for s, e, h in zip(starts, ends, tx.hashed(data, starts, ends).tolist()):
            assert seen.setdefault(data[s:e].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)
