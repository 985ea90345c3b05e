import random

import numpy as np
import pyarrow as pa

from linewright.llm import shingles
from linewright.llm._common import space_words

TEXTS = [None, "", "  ", "a", "B b", "x\ty\nz\x0b\x0c\r end", "é É ß x", "one two three four five six ONE", "q" * 9000 + " tail " + "Q" * 9000, "0 \x00 \x1f 1"]


def test_words_of_columns_are_those_of_texts(monkeypatch):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice(["a", "bb", "Ccc", "ü", " ", "\n"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    for column in (pa.array(texts, pa.string()), pa.array(["skipped", *texts], pa.string()).slice(1), pa.array(texts, pa.large_string())):
        for buffer in (1 << 20, 64):
            monkeypatch.setattr(shingles, "BUFFER", buffer)
            hashes, counts = shingles.text_words(column)
            words = [space_words(t) for t in texts]
            assert counts.tolist() == [len(w) for w in words]
            flat = [w for x in words for w in x]
            of = {}
            assert all(of.setdefault(w, h) == h for w, h in zip(flat, hashes.tolist(), strict=True)) or buffer == 64
            assert buffer == 64 or len(set(of.values())) == len(of)
    assert [len(x) for x in shingles.text_words(pa.array([], pa.string()))] == [0, 0]
    assert shingles.text_words(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0]


def test_sets_are_those_of_tuples():
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice("abc") for _ in range(n)) for n in (1, 3, 4, 5, 6, 50, 400)]
    sets = shingles.shingle_sets(*shingles.text_words(pa.array(texts, pa.string())), 5)
    names = {}
    for t, s in zip(texts, sets, strict=True):
        w = space_words(t)
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        assert len(s) == len(want) and (np.diff(s.astype(object)) > 0).all()
        names.setdefault(frozenset(want), set()).add(tuple(s.tolist()))
    assert all(len(x) == 1 for x in names.values())
