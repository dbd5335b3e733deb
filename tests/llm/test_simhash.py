"""Fingerprints and links against plain versions and all pairs."""

import random
import re

import numpy as np
import xxhash

import brute
from gridprep.llm import simhash

SCHEMA = "doc_id long, text string"


def plain(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, radius=2):
    """{id: smallest id reachable} of {id: fingerprint}, over all pairs."""
    return brute.reachable(list(values), lambda a, b: (values[a] ^ values[b]).bit_count() <= radius)


def test_fingerprints(monkeypatch):
    texts = ["", None, " \n", "One", "one TWO", "Éa É b c", "a\tb c d\x0be", " ".join(f"W{i % 50}" for i in range(3000))]
    for text in texts:
        assert simhash.fingerprint(text) == plain(text)
    monkeypatch.setattr(simhash, "SLICE", 7)  # words of a text in many slices
    for text in texts:
        assert simhash.fingerprint(text) == plain(text)


def test_tree_finds_all_within_the_radius():
    chance = np.random.default_rng(1)
    values = chance.integers(0, 1 << 63, 40, dtype=np.uint64)
    for _ in range(4):  # clusters of fingerprints that differ in few bits
        values = np.unique(np.concatenate([values, values ^ (np.uint64(1) << chance.integers(0, 64, len(values), dtype=np.uint64))]))
    nodes, edges = simhash.build_tree(values)
    assert sorted(nodes.tolist()) == sorted(values.tolist()) and (np.diff(edges) > 0).all()
    for radius in (0, 1, 2, 5):
        found = [(int(q), int(nodes[n])) for qs, ns in simhash.search_tree(nodes, edges, values, radius) for q, n in zip(qs, ns)]
        distances = np.bitwise_count(values[:, None] ^ values[None, :])
        assert sorted(found) == sorted((int(i), int(values[j])) for i, j in zip(*np.nonzero(distances <= radius)))


def test_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 8)
    monkeypatch.setattr(simhash, "PASS_BYTES", 4096)
    chance = random.Random(3)
    texts = {}
    for group in range(12):
        words = [f"w{chance.randrange(300)}" for _ in range(150)]
        for _ in range(15):
            texts[len(texts) * 3 % 541] = " ".join(words)
            words[chance.randrange(len(words))] = f"x{chance.randrange(300)}"
    texts |= {1000: "", 1001: None, 1002: "  ", 2000: "one", 1999: "ONE"}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], SCHEMA + ", fingerprint int")
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    values = {i: plain(t) for i, t in texts.items()}
    roots = linked(values)
    assert found == {i: (f"{values[i]:016x}", roots[i]) for i in texts}
    assert len(set(roots.values())) < len(texts) - 20


def test_many_near_copies_give_few_links(spark):
    chance = random.Random(5)
    base = chance.getrandbits(64)
    values = {base}
    while len(values) < 1500:
        value = base
        for _ in range(chance.randrange(1, 4)):
            value ^= 1 << chance.randrange(64)
        values.add(value)
    signed = [(v - (1 << 64) if v >= 1 << 63 else v,) for v in values]
    links = simhash.near_links(spark.createDataFrame(signed, "fingerprint long")).distinct().count()
    pairs = sum((a ^ b).bit_count() <= 2 for a in values for b in values) // 2
    assert links < 20 * len(values) and links < pairs


def test_null_ids_repeats_and_an_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (3, "A b c  d"), (None, "q r s t u")], SCHEMA)
    found = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert found == [(3, 3), (5, 3), (5, 3), (None, 3), (None, None)]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
