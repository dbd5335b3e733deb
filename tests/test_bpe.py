"""BPE against the public tokenizers library."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")

from gridprep.functions.text import words  # noqa: E402
from gridprep.operators import bpe  # noqa: E402
from gridprep.operators.bpe import BPE_SPECIAL_TOKENS, apply_merges, bpe_encode, bpe_train, bpe_vocab  # noqa: E402


def corpus(seed, n=60):
    chance = random.Random(seed)
    stems = ["ab", "abc", "ba", "cab", "aab", "bcb", "xyx", "yx~", "00", "a00b", "zz", "zzz", "é", "ﬁx"]
    return [" ".join("".join(chance.choices(stems, k=chance.randint(1, 3))) for _ in range(12)) for _ in range(n)]


def reference(texts, **options):
    tokenizer = tokenizers.Tokenizer(tokenizers.models.BPE())
    tokenizer.normalizer = tokenizers.normalizers.NFKC()
    tokenizer.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
    trainer = tokenizers.trainers.BpeTrainer(special_tokens=BPE_SPECIAL_TOKENS, show_progress=False, **options)
    tokenizer.train_from_iterator(texts, trainer)
    return tokenizer


@pytest.mark.parametrize("options", [{"vocab_size": 44}, {"vocab_size": 45, "min_frequency": 30}, {"max_token_length": 1, "vocab_size": 32}, {"max_token_length": 4, "vocab_size": 38}])
def test_training_and_encoding(spark, options):
    texts = corpus(len(str(options)))
    expected = reference(texts, **options)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, text STRING")
    model = bpe_train(df, **options)
    assert {t: i for i, t in enumerate(model.tokens)} == expected.get_vocab()
    assert bpe_vocab(spark, model).count() == expected.get_vocab_size()
    probes = texts[:20] + ["[BOS] abab ~a~ 000 q unseen abcabc [EOS]", "", "ﬁ éa 00a00"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(probes)], "i INT, text STRING")
    found = bpe_encode(rows.withColumn("window", words(F.col("text"))), model)
    for row in found.collect():
        encoding = expected.encode(" ".join(probes[row["i"]].split()))
        assert row["input_ids"] == encoding.ids, probes[row["i"]]
        assert row["attention_mask"] == encoding.attention_mask
        assert row["input_text"] == " ".join(probes[row["i"]].split())


def test_merge_limit(spark):
    df = spark.createDataFrame([("aa aa ab",)], "text STRING")
    assert [model for model in bpe_train(df, max_merges=1, special=[]).merges] == [(0, 0, 2)]


def slow_merges(symbols, ranks):
    symbols = list(symbols)
    while True:
        known = [(ranks[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        if not known:
            return symbols
        i = min(known)[1]
        symbols[i:i + 2] = [ranks[symbols[i], symbols[i + 1]][1]]


def test_merges_by_heap():
    chance = random.Random(2)
    for _ in range(50):
        ranks, size = {}, 3
        for rank in range(12):
            pair = chance.randrange(size), chance.randrange(size)
            if pair not in ranks:
                ranks[pair], size = (rank, size), size + 1
        symbols = [chance.randrange(3) for _ in range(chance.randrange(0, 40))]
        assert apply_merges(symbols, ranks) == slow_merges(symbols, ranks)


def test_a_long_word_is_fast():
    ranks = {(0, 0): (0, 1), (1, 1): (1, 2), (2, 2): (2, 3), (3, 0): (3, 4), (0, 5): (4, 6)}
    started = time.perf_counter()
    assert len(apply_merges([0] * 19_999 + [5], ranks)) < 2600
    assert time.perf_counter() - started < 1


def test_long_words_and_rewriting_of_the_index(spark, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_WORD", 4)
    monkeypatch.setattr(bpe, "COMPACT_EVERY", 3)
    texts = corpus(11)
    model = bpe_train(spark.createDataFrame([(t,) for t in texts], "text STRING"), vocab_size=32)
    assert {t: i for i, t in enumerate(model.tokens)} == reference(texts, vocab_size=32).get_vocab()


def test_later_rounds_read_less(spark, monkeypatch):
    """A round reads the files of its pairs' buckets, a small part of the index."""
    read, touched = [], []
    original = bpe.PairIndex.words

    def watched(self, pairs):
        found = original(self, pairs)
        buckets = {(a * 31 + b) % bpe.BUCKETS for a, b in pairs}
        folder = self.path.removeprefix("file:")
        sizes = {b: sum(os.path.getsize(os.path.join(at, f)) for at, _, fs in os.walk(os.path.join(folder, b)) for f in fs) for b in os.listdir(folder) if "=" in b}
        read.append((sum(sizes.get(f"bucket={b}", 0) for b in buckets) / sum(sizes.values())))
        touched.append(found.count() / len(pairs))
        return found

    monkeypatch.setattr(bpe.PairIndex, "words", watched)
    chance = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(chance.choices(letters, range(26, 0, -1), k=chance.randint(2, 9))) for _ in range(4000)]
    bpe_train(spark.createDataFrame([(t,) for t in texts], "text STRING"), max_merges=16)
    assert len(read) >= 4 and max(read) < 0.5 and sum(read) / len(read) < 0.2
    assert sum(touched[-2:]) < 0.7 * sum(touched[:2])
