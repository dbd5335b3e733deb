"""Word and shingle hashes against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

from gridprep.llm import words as W

random.seed(1)
TEXTS = ["", None, "a", " a b ", "The the THE", "x\ty\nz\x0bq\x0cw\rv", "é É e", "a\xa0b", "a"] + [
    " ".join(random.choice(["ab", "Ab", "c", "dé", "eee,"]) for _ in range(random.randrange(0, 30))) for _ in range(200)
]


def one_to_one(keys, values):
    found = {}
    for key, value in zip(keys, values):
        assert found.setdefault(key, value) == value
    assert len(set(found.values())) == len(found)


@pytest.mark.parametrize("texts", [TEXTS, [], [None], [""], ["w" * 200_000 + " a " + "b" * 10, "a " * 100_000, "z"]])
def test_words_and_shingles(texts):
    data, offsets = W.column_bytes(pa.array(texts, pa.string()))
    hashes, bounds = W.word_hashes(data, offsets)
    expected = [(t or "").encode().lower().split() for t in texts]
    assert [len(r) for r in expected] == list(np.diff(bounds))
    one_to_one([w for r in expected for w in r], hashes)
    for size in (1, 2, 5):
        shingles, bounds_of = W.shingle_hashes(hashes, bounds, size)
        rows = [[tuple(r[i:i + size]) for i in range(max(1, len(r) - size + 1))] if r else [] for r in expected]
        assert [len(r) for r in rows] == list(np.diff(bounds_of))
        one_to_one([s for r in rows for s in r], shingles)


def test_a_sliced_column_and_typographic_signs():
    column = pa.array(["skipped", "a–b „c“", "x"]).slice(1, 1)
    data, offsets = W.column_bytes(column)
    assert len(W.word_hashes(data, offsets, letters_only=True)[0]) == 3
    beginnings, _ = W.word_hashes(*W.column_bytes(pa.array(["vequai vequta"])), most=4)
    assert beginnings[0] == beginnings[1]
