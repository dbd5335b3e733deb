"""Toxicity of documents by a counterfactual-regularised linear classifier.

Features are the presence of words and of word beginnings of `STEM` bytes, which stand for inflected forms
that no labelled text holds. Which of them become features is decided by counts over the labelled
sample; identity terms always do. Besides the logistic loss, training swaps the identity
terms of each labelled text for other ones and penalises the square of the change in score, so that the
mere mention of a group carries no weight of its own.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridprep.llm import words as W
from gridprep.llm.logistic import Rows, fit, sigmoid
from gridprep.llm.tables import written

SAMPLE = 20_000
BUCKETS = 1 << 20
FEATURES = 4096
LEAST_DOCUMENTS = 5
COUNTERFACTUAL = 10.0
PENALTY = 1e-3
# identity terms: each can stand for any other of its line (fixed values, English)
IDENTITY_TERMS = [
    ["women", "men"],
    ["woman", "man"],
    ["female", "male"],
    ["girls", "boys"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "arab"],
    ["african", "european", "american", "mexican", "chinese", "indian"],
    ["gay", "lesbian", "bisexual", "transgender", "straight", "heterosexual"],
    ["immigrants", "refugees", "foreigners", "citizens", "natives"],
    ["old", "young", "elderly"],
    ["blind", "deaf", "disabled", "autistic"],
]
SLICE = 2 << 20
STEM = 4
_STEM_MARK = np.uint64(0x5DEECE66D)


def _tokens(data, offsets):
    """Hashes of the words and, after each, of its beginning; offsets of the rows."""
    hashes, bounds = W.word_hashes(data, offsets, letters_only=True)
    stems, _ = W.word_hashes(data, offsets, letters_only=True, most=STEM)
    return np.stack([hashes, W.mix(stems ^ _STEM_MARK)], axis=1).ravel(), bounds * 2


def identity_lines():
    """The tokens (word, beginning) of the identity terms, line by line."""
    return [[tuple(int(h) for h in _tokens(*W.column_bytes(pa.array([term])))[0]) for term in line] for line in IDENTITY_TERMS]


def feature_hits(column, keys):
    """Slices of a text column: (first row, rows, row of each hit, feature of each hit), each pair once.

    `keys` are the sorted hashes of the features.
    """
    data, offsets = W.column_bytes(column)
    seen = np.zeros(1 << 16, bool)
    seen[keys & np.uint64(0xFFFF)] = True
    for low, high in W.slices(offsets, SLICE):
        hashes, bounds = _tokens(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
        at = np.flatnonzero(seen[hashes & np.uint64(0xFFFF)])
        feature = np.searchsorted(keys, hashes[at])
        same = feature < len(keys)
        same[same] = keys[feature[same]] == hashes[at[same]]
        at, feature = at[same], feature[same]
        row = np.searchsorted(bounds, at, "right") - 1
        pairs = W.distinct(row * np.int64(len(keys) + 1) + feature)
        yield low, high - low, pairs // (len(keys) + 1), pairs % (len(keys) + 1)


def _word_counts(batches):
    """(word, documents of label 0, of label 1) over a task's rows (label, text)."""
    words, positive = [], []
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = W.column_bytes(batch.column(1))
        for low, high in W.slices(offsets, SLICE):
            hashes, bounds = _tokens(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
            for i in range(high - low):
                found = W.distinct(hashes[bounds[i]:bounds[i + 1]])
                words.append(found)
                positive.append(np.full(len(found), label[low + i], np.int8))
    if words:
        keys, place = np.unique(np.concatenate(words), return_inverse=True)
        positive = np.concatenate(positive)
        n = np.bincount(place, minlength=len(keys))
        n1 = np.bincount(place, weights=positive, minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(W.as_signed(keys)), pa.array(n - n1), pa.array(n1)], names=["word", "n0", "n1"])


def _sample_hits(keys):
    def run(batches):
        for batch in batches:
            for low, n, row, feature in feature_hits(batch.column(1), keys):
                offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature.astype(np.int32)))],
                    names=["label", "features"],
                )

    return run


def labelled_ids(labels, label):
    """(doc_id, label) of each labelled id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))  # labelled twice: 1 wins


def bounded_sample(labels, label, most):
    """At most `most` labelled ids: those with the smallest hashes."""
    rows = labelled_ids(labels, label)
    # sorted are little more rows than are wanted: those of the first buckets of the hash
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    share = min(1.0, 1.5 * most / max(1, rows.count()))
    return rows.where(bucket < int(BUCKETS * share) + 1).orderBy(bucket, F.xxhash64("doc_id"), "doc_id").limit(most)


def sample_texts(docs, chosen):
    """One row (label, text) for each chosen id that has any: of rows that repeat it, the text with the smallest hash."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(one).select("label", "text")


def _swaps(keys, feature, lines):
    """Differences between the sample's texts and their copies with another identity term."""
    place = {int(k): i for i, k in enumerate(keys)}
    rows, columns, values, count = [], [], [], 0
    for line in lines:
        for a in line:
            texts = int((feature == place[a[0]]).sum())
            for b in line if texts else []:
                if a != b:
                    weight = np.sqrt(texts)
                    rows += [count] * 4
                    columns += [place[t] for t in (*a, *b)]
                    values += [-weight, -weight, weight, weight]
                    count += 1
    return Rows(np.array(rows, np.int64), np.array(columns, np.int64), np.array(values, float), count, len(keys))


def train(docs, labels, sample=SAMPLE, features=FEATURES):
    """(sorted feature hashes, weights, intercept) from at most `sample` labelled documents.

    `labels` has (doc_id, toxic) of the rows to learn from. With no usable label the model scores every
    text 0.
    """
    chosen = bounded_sample(labels, "toxic", sample)
    rows = written(sample_texts(docs, chosen), "sample")
    lines = identity_lines()
    always = {t for line in lines for term in line for t in term}
    counts = rows.mapInArrow(_word_counts, "word bigint, n0 bigint, n1 bigint").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    totals = rows.agg(F.count("*").alias("n"), F.sum("label").alias("n1")).head()
    n1, n0 = int(totals["n1"] or 0), int(totals["n"]) - int(totals["n1"] or 0)
    if not n1 or not n0:
        return np.array(sorted(always), np.uint64), np.zeros(len(always)), -40.0 if not n1 else 40.0
    odds = F.log((F.col("n1") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("n0") + 0.5) / F.lit(n0 + 1.0))
    strength = F.abs(odds) / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    best = counts.where(F.col("n0") + F.col("n1") >= LEAST_DOCUMENTS).orderBy(strength.desc(), "word").limit(features).select("word").toArrow()["word"]
    keys = np.array(sorted(always | {int(x) for x in best.to_numpy().view(np.uint64)}), np.uint64)
    found = rows.mapInArrow(_sample_hits(keys), "label int, features array<int>").toArrow()
    label = found["label"].to_numpy().astype(float)
    lists = found["features"].combine_chunks()
    feature = lists.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(label)), lists.value_lengths().to_numpy())
    data = Rows(row, feature, np.ones(len(row)), len(label), len(keys))
    weights, intercept = fit(data, label, penalty=PENALTY, balanced=True, equal=_swaps(keys, feature, lines), equal_penalty=COUNTERFACTUAL)
    return keys, weights, intercept


def _score(keys, weights, intercept):
    def run(batches):
        for batch in batches:
            for low, n, row, feature in feature_hits(batch.column(1), keys):
                score = sigmoid(np.bincount(row, weights=weights[feature], minlength=n) + intercept)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, n), pa.array(score)], names=["doc_id", "score"])

    return run


def score(docs, model):
    """One row per row of `docs` (doc_id, text): doc_id, score (0 to 1, higher is more toxic).

    Null and empty texts score as a text without features. Repeated rows each get a row; other columns are
    ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(*model), "doc_id bigint, score double")
