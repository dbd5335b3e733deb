"""Packing: exact round trip of ids, gapless sequences, few of them."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridprep.llm import packing, tokens

PATHS = tokens.default_paths()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATHS[0])


def test_ids_are_those_of_the_tokenizer(tokenizer, monkeypatch):
    random.seed(3)
    letters = ["ab 'sdtre.,!? \n\t\r0129", "aé ßñ\xa1\xbf×÷ªºŉǅɏ 'llve \n\n\t12²³¼", "ab ​　中文\x85\xa0\x1c\x00\x7f 😀 '", "<|endoftext|> a"]
    for chunk in (1 << 20, 20):
        monkeypatch.setattr(tokens, "CHUNK", chunk)
        for _ in range(2000):
            text = "".join(random.choice(random.choice(letters)) for _ in range(random.randrange(0, 60))) + " word two abc def" * (chunk == 20)
            assert list(tokens.token_ids(text, PATHS)) == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [10, 64, 1024])
def test_plan_uses_every_piece_once(capacity):
    random.seed(capacity)
    counts = {random.randrange(1, capacity + 1): random.randrange(1, 500) for _ in range(60)}
    used, sequences = Counter(), 0
    for first, repeats, chosen in packing.plan(counts, capacity):
        assert first == sequences and sum(n * t for n, t in chosen.items()) <= capacity
        sequences += repeats
        for length, times in chosen.items():
            used[length] += times * repeats
    assert used == Counter(counts)


def test_the_fullest_combination():
    assert packing.fullest(6, {6: 1, 3: 2, 2: 5}, 10) == {6: 1, 2: 2}
    assert packing.fullest(7, {7: 1}, 10) == {7: 1}
    assert sum(n * t for n, t in packing.fullest(50, {50: 1, 31: 2, 17: 3, 9: 4}, 100).items()) == 99


def test_few_sequences_for_many_documents():
    random.seed(9)
    counts = Counter(min(1024, int(random.lognormvariate(6, 0.9)) + 1) for _ in range(20_000))
    sequences = sum(b[1] for b in packing.plan(dict(counts)))
    assert sequences <= 1.01 * sum(n * c for n, c in counts.items()) / 1024


def test_pieces(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = [(9000, None), (9001, ""), (9002, "word " * 5000), (9003, "x" * 30_000), (None, "null id"), (9004, "same"), (9004, "same")]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    found = packing.pack(docs.selectExpr("*", "1 AS length")).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for k, t in texts.items()}
    for row in found.itertuples():
        part = np.array(ids[None if np.isnan(row.doc_id) else row.doc_id][row.start:row.start + row.length], "<u4")
        assert len(part) == row.length and zlib.crc32(part.tobytes()) == row.ids_crc32
    for doc, pieces in found[found.doc_id != 9004].sort_values("piece").groupby("doc_id"):
        assert list(pieces.start) == [0, *np.cumsum(pieces.length)[:-1]] and pieces.length.sum() == len(ids[doc])
        assert list(pieces.piece) == list(range(len(pieces))) and (pieces.length[1:] == 1024).all()
    for _, pieces in found.sort_values("offset").groupby("sequence_id"):
        assert list(pieces.offset) == [0, *np.cumsum(pieces.length)[:-1]] and pieces.length.sum() <= 1024
    assert (found.doc_id == 9004).sum() == 2
    assert packing.pack(docs.where("false")).count() == 0
