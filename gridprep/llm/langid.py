"""Language of documents by inference of a mixture of languages.

Training counts hashed byte trigrams per language over all training texts. A document is then a
mixture: each of its words was written in one language, with the probability that the language's
trigrams give it. Expectation-maximisation estimates the share of each language; this is done for
the single best language and for the sets of its two, three, ... largest shares, up to all languages, and the
set with the largest likelihood less a penalty (half the logarithm of the number of words for each language,
as in the BIC) is taken. Sets are tried for a document as long as a bound on the likelihood of all mixtures
leaves room for a larger one to win.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridprep.llm import words as W
from gridprep.llm.tables import fold_of

BUCKETS = 1 << 16
ROUNDS = 8
SLACK = 1e-3  # of log likelihood a word, for rounding
SMOOTHING = 0.5
MOST_LANGUAGES = 1000
UNKNOWN = "und"

# A-Z lower-cased, every other ASCII sign a blank
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_FOLDED[[c for c in range(128) if not chr(c).isalpha()]] = 32


def _padded(data, offsets):
    """The rows with a blank before each and two after the last, and their new offsets."""
    out = np.full(len(data) + len(offsets) + 1, 32, np.uint8)
    place = np.arange(len(data)) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    out[place] = _FOLDED[data]
    return out, offsets + np.arange(1, len(offsets) + 1)


def _trigrams(data):
    """The bucket of the three bytes that start at each place."""
    x = data.astype(np.uint32)
    x = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return ((x * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)


def _words(data, offsets):
    """(buckets, first trigram of each word, place after its last one, word offsets of the rows)."""
    data, offsets = _padded(data, offsets)
    letter = data != 32
    change = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    starts, ends = change[::2], change[1::2]
    return _trigrams(data), starts - 1, ends - 1, np.searchsorted(starts, offsets)


def _count(batches):
    totals = {}
    for batch in batches:
        data, offsets = W.column_bytes(batch.column(1))
        langs = batch.column(0).to_pylist()
        for low, high in W.slices(offsets, 1 << 20):
            grams, first, last, rows = _words(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
            inside = np.zeros(len(grams) + 1, np.int8)
            np.add.at(inside, first, 1)
            np.add.at(inside, last, -1)
            inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
            present = sorted(set(langs[low:high]))
            place = {lang: i * BUCKETS for i, lang in enumerate(present)}
            lengths = np.diff(offsets[low:high + 1]) + 1  # with the blank before a row; one more at the end
            lengths[-1] += len(grams) - lengths.sum()
            keys = grams + np.repeat(np.array([place[x] for x in langs[low:high]], np.int64), lengths)
            found = np.bincount(keys[inside], minlength=len(present) * BUCKETS).reshape(-1, BUCKETS)
            for lang, row in zip(present, found):
                totals[lang] = totals.get(lang, 0) + row
    for lang, total in totals.items():
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used])],
            names=["lang", "bucket", "n"],
        )


def train(texts):
    """(languages, log probability of every trigram bucket for each) from a table (lang, text).

    What comes to the driver is one number per language and used bucket, summed over all texts.
    """
    texts = texts.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = texts.where("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(_count, "lang string, bucket int, n bigint")
    table = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(table["lang"].to_pylist()))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; one model holds {MOST_LANGUAGES}")
    place = {lang: i for i, lang in enumerate(languages)}
    seen = np.zeros((len(languages), BUCKETS))
    if languages:
        seen[[place[x] for x in table["lang"].to_pylist()], table["bucket"].to_numpy()] = table["n"].to_numpy()
    seen += SMOOTHING
    return languages, np.log(seen / seen.sum(axis=1, keepdims=True)).astype(np.float32)


def _row_sums(values, rows, counts):
    """Sums over the words of each row along the last axis; rows have `counts` words."""
    out = np.zeros((*values.shape[:-1], len(counts)), np.float64)
    full = counts > 0
    if full.any():
        out[..., full] = np.add.reduceat(values, rows[:-1][full], axis=-1)
    return out


def _mixture(like, rows, counts, allowed):
    """Shares of the allowed languages (languages x rows), and the log likelihood of each row's words.

    `like` is languages x words, 1 for a word's best language.
    """
    share = (allowed / allowed.sum(axis=0)).astype(np.float32)
    alone = allowed.sum(axis=0).max() == 1
    for _ in range(0 if alone else ROUNDS):
        part = like * np.repeat(share, counts, axis=1)
        part /= part.sum(axis=0)
        share = np.where(counts > 0, _row_sums(part, rows, counts) / np.maximum(counts, 1), share).astype(np.float32)
    total = (like * np.repeat(share, counts, axis=1)).sum(axis=0)
    return share, _row_sums(np.log(np.maximum(total, np.float32(1e-30))), rows, counts)


def _ceiling(like, rows, counts, share, fit):
    """What the log likelihood of each row's words cannot exceed, whatever the shares.

    Against the given shares it gains at most the logarithm of the mean ratio for every word (Jensen), and
    the mean ratio of a mixture is at most that of one of its languages."""
    ratio = _row_sums(like / (like * np.repeat(share, counts, axis=1)).sum(axis=0), rows, counts).max(axis=0)
    return np.minimum(fit + counts * np.log(np.maximum(ratio / np.maximum(counts, 1), 1)), 0) + SLACK * counts


def infer(log_p, data, offsets):
    """(index of the main language, its share, number of languages of the chosen set) of every row."""
    grams, first, last, rows = _words(data, offsets)
    counts = np.diff(rows)
    k, n = len(log_p), len(counts)
    if len(first) == 0:
        return np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
    edges = np.stack([first, last], axis=1).ravel()
    score = np.stack([np.add.reduceat(row[grams], edges)[::2] for row in log_p])
    like = np.maximum(np.exp(score - score.max(axis=0)), np.float32(1e-12))
    share, whole = _mixture(like, rows, counts, np.ones((k, n), np.float32))
    rank = np.argsort(np.argsort(-share, axis=0, kind="stable"), axis=0, kind="stable")
    most, penalty = _ceiling(like, rows, counts, share, whole), 0.5 * np.log(np.maximum(counts, 1))
    best, shares, size = np.full(n, -np.inf), share.copy(), np.ones(n, np.int64)
    left = np.arange(n)  # rows for which a larger set can still win
    for languages in range(1, k + 1):
        if languages == k:
            some, fit = share[:, left], whole[left]
        else:
            some, fit = _mixture(like, rows, counts, (rank[:, left] < languages).astype(np.float32))
        value = fit - languages * penalty[left]
        better = value > best[left]
        taken = left[better]
        best[taken], size[taken], shares[:, taken] = value[better], languages, some[:, better]
        stays = best[left] < most[left] - (languages + 1) * penalty[left]
        if not stays.any():
            break
        if languages + 1 < k and not stays.all():
            like, counts = like[:, np.repeat(stays, counts)], counts[stays]
            rows = np.concatenate([[0], np.cumsum(counts)])
        left = left[stays]
    main = shares.argmax(axis=0)
    return main, shares[main, np.arange(n)].astype(np.float64), size


def _predict(languages, log_p):
    def run(batches):
        names = pa.array([*languages, UNKNOWN])
        for batch in batches:
            data, offsets = W.column_bytes(batch.column(1))
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            most = max(1 << 16, (1 << 22) // max(1, len(languages)))
            for low, high in W.slices(offsets, most):
                known = letters[low:high]
                if languages:
                    main, share, size = infer(log_p, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                else:
                    main, share, size = (np.zeros(high - low, np.int64) for _ in range(3))
                    known = np.zeros(high - low, bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        names.take(pa.array(np.where(known, main, len(languages)))),
                        pa.array(np.clip(np.where(known, share, 0.0), 0, 1)),
                        pa.array(np.where(known, size, 0).astype(np.int32)),
                    ],
                    names=["doc", "lang_pred", "score", "n_languages"],
                )

    return run


def identify(docs, model):
    """One row per row of `docs` (text, ...): doc (the row), lang_pred, score, n_languages.

    `score` is the share of the main language. A null, empty or letterless text is `und` with score 0 and no
    languages, and so is every text if the model has no language. Ties go to the language
    first in the alphabet. Repeated rows each get a row. The row is kept whole in `doc`, so that no column
    of it can clash.
    """
    languages, log_p = model
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(_predict(languages, log_p), f"doc {rows.schema['doc'].dataType.simpleString()}, lang_pred string, score double, n_languages int")


def train_fold(docs, folds=4, held_out=2):
    """A model from the documents outside the held-out fold."""
    return train(docs.where(fold_of("doc_id", folds) != held_out).select("lang", "text"))
