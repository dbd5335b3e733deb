"""Near duplicates against all pairs."""

import random

import numpy as np
import pytest

import brute
from gridprep.llm import dedup
from gridprep.llm.components import components

SCHEMA = "doc_id long, text string"


def copies(seed=2):
    """Texts with chains of edits: neighbours are alike, the ends are not."""
    random.seed(seed)
    texts, place = {}, 0
    for _ in range(6):
        words = [f"w{random.randrange(500)}" for _ in range(60)]
        for _ in range(12):
            texts[place] = " ".join(words)
            place += random.randrange(1, 4)
            for _ in range(random.randrange(0, 4)):
                words[random.randrange(len(words))] = f"w{random.randrange(500)}"
    texts |= {1000: "", 1001: None, 1002: "one", 1003: "ONE", 1004: "one\ttwo", 1005: "One  two", 1006: " \n "}
    return texts


@pytest.mark.parametrize("size", [2, 5])
def test_components(spark, size):
    texts = copies()
    docs = spark.createDataFrame([(i, t, 7) for i, t in texts.items()], SCHEMA + ", component_id int")
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in dedup.near_duplicates(docs, size).collect()}
    assert found == {i: (n, root, root == i) for i, (n, root) in brute.duplicates(texts, size).items()}


def test_null_ids_repeats_and_an_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (3, "A b c")], SCHEMA)
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in dedup.near_duplicates(docs, 2).collect()), key=str)
    assert found == [(3, 3, True), (5, 3, False), (5, 3, False), (None, None, True)]
    assert dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_estimate_is_near_the_truth(spark):
    random_ = np.random.default_rng(4)
    rows = []
    for share in (0.2, 0.5, 0.8, 1.0):
        a = random_.integers(0, 1 << 63, 2000, dtype=np.uint64)
        b = a.copy()
        b[int(2000 * 2 * share / (1 + share)):] = random_.integers(0, 1 << 63, 2000 - int(2000 * 2 * share / (1 + share)), dtype=np.uint64)
        packed = dedup.packed(np.array([dedup.minima(a)[:dedup.HASHES], dedup.minima(b)[:dedup.HASHES]]))
        rows.append((share, *(p.view(np.int64).tolist() for p in packed)))
    df = spark.createDataFrame(rows, "share double, a array<long>, b array<long>")
    for row in df.select("share", dedup.estimated_similarity(df.a, df.b).alias("estimate")).collect():
        assert abs(row.share - row.estimate) < 0.2
        assert row.share < 1 or row.estimate == 1


def test_a_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in components(links).collect()}
    assert found == {i: 0 for i in range(201)} | {400: 400, 500: 400}


def test_large_groups_of_near_copies_and_a_long_text(spark, monkeypatch):
    """Near copies of one text give few links, however many there are."""
    chance = random.Random(6)
    base = [f"w{chance.randrange(900)}" for _ in range(200)]
    texts = {}
    for i in range(1200):
        words = list(base)
        for _ in range(chance.randrange(1, 5)):
            words[chance.randrange(200)] = f"x{chance.randrange(900)}"
        texts[i * 2] = " ".join(words)
    long = [f"v{chance.randrange(5000)}" for _ in range(60_000)]
    texts[5001] = " ".join(long)
    texts[5002] = " ".join(long[:-3000])
    given = []
    monkeypatch.setattr(dedup, "components", lambda links: given.append(links.distinct().count()) or components(links))
    docs = spark.createDataFrame(list(texts.items()), SCHEMA)
    found = {r.doc_id: r.component_id for r in dedup.near_duplicates(docs, 2).collect()}
    expected = brute.duplicates({i: t for i, t in texts.items() if i < 200 or i > 5000}, 2)
    assert all(found[i] == root for i, (_, root) in expected.items())
    assert {found[i] for i in texts if i < 5000} == {0} and found[5002] == 5001
    assert max(given) <= 3 * len(texts)
