"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridprep.llm import variants

SCHEMA = "doc_id long, text string"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_counts(docs, misspell=199):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if misspell and h % misspell == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_groups(counts):
    """{word: (form, root, n, n_near, form_n)} over all pairs."""
    by_length, forms, out = {}, {}, {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)
    for w in counts:
        around = [v for n in (len(w) - 1, len(w), len(w) + 1) for v in by_length.get(n, ()) if near(w, v)]
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
        out[w] = len(around)
    result = {}
    for w in counts:
        root = w
        while forms[root] is not None:
            root = forms[root]
        result[w] = (forms[w], root, counts[w], out[w], counts[forms[w]] if forms[w] else None)
    return result


def corpus(seed=1, docs=60):
    chance = random.Random(seed)
    syllables = ["ba", "na", "ti", "on", "éa", "ß", "Ü", "er", "ch", "x"]
    words = ["".join(chance.choices(syllables, k=chance.randint(2, 5))) for _ in range(120)]
    words += [w[:i] + w[i + 1:] for w in words[:60] for i in (1, 3)] + [w[:2] + "z" + w[2:] for w in words[:60]]
    weights = [1 / (1 + i % 40) ** 1.6 for i in range(len(words))]
    texts = [" ".join(w.upper() if chance.random() < 0.1 else w for w in chance.choices(words, weights, k=400)) for _ in range(docs)]
    texts += ["bananani " * 700 + "banananix " * 100 + "banananixx " * 15]
    return [(i * 7, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("cell", [16_384, 24])
def test_groups(spark, monkeypatch, cell):
    monkeypatch.setattr(variants, "CELL", cell)
    monkeypatch.setattr(variants, "LEAF", 8)
    docs = corpus() + [(None, "Banana " * 6 + "naïve1naïve"), (3, None), (4, ""), (5, "9 ×÷ ."), (6, "a" * 70_000 + " " + ("b" * 3000 + " ") * 6)]
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], SCHEMA + ", word string, n int")
    counts = variants.word_counts(df, misspell=199)
    expected = plain_counts(docs)
    assert {r.word: r.n for r in counts.collect()} == expected
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.group_variants(counts).collect()}
    groups = plain_groups(expected)
    assert found == groups
    assert sum(g[0] is not None for g in groups.values()) > 10 and any(g[0] != g[1] for g in groups.values() if g[0])


def test_text_in_slices(monkeypatch):
    text = "Hello world, some letters " * 40 + "q" * 100
    whole = [w for some in variants._runs(text.lower(), 5) for w in some]
    monkeypatch.setattr(variants, "SLICE", 7)
    assert [w for some in variants._runs(text.lower(), 5) for w in some] == whole


def test_near_pairs_of_long_and_repeated_letters():
    chance = random.Random(4)
    words = sorted({"".join(chance.choices("ab", k=9)) for _ in range(300)} | {"a" * 9, "b" * 9})
    longer = sorted({"".join(chance.choices("ab", k=10)) for _ in range(300)} | {"a" * 10})
    for first, second in ((words, words), (words, longer)):
        found = {(first[i], second[j]) for some in variants.near_pairs(first, second) for i, j in zip(*some)}
        own = first is second
        assert found == {(a, b) for x, a in enumerate(first) for y, b in enumerate(second) if near(a, b) and (not own or x < y)}
    assert variants.letter_counts(np.full((1, 5000), 97, np.uint32)).max() == variants.MOST_COUNT


def test_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert variants.group_variants(variants.word_counts(empty)).count() == 0
