"""Quality of documents by Bradley-Terry ranking of pairs.

A document's strength is a linear function of binned surface features. It is learned from pairs of a
better and a worse labelled document by logistic loss on the difference of their features. All labelled documents are
learned from: their features, bins and pairs are tables, and each round of the fit sums over them in the tasks. Documents
above a quantile of the strengths of the labelled ones (the share of bad ones among them) are taken as good;
scores are scaled so that this strength scores `CUT`.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridprep.llm import words as W
from gridprep.llm.logistic import fit_table, sigmoid
from gridprep.llm.tables import written
from gridprep.llm.toxicity import labelled_ids
from gridprep.operators.joins import broadcast_if_small, is_small
from gridprep.operators.ranking import global_rank

PAIRS = 8  # of each document of the larger class
ACCURACY = 1 << 18  # quantiles are exact for so many rows of a class, and beyond by rank within rows / ACCURACY
PIECE = 4096
BINS = 10
CUT = 0.7
SLICE = 2 << 20

_KINDS = np.zeros(256, np.uint8)  # 0 other ASCII sign, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 .,;:!?'"-, 6 not ASCII
for _c in range(256):
    _s = chr(_c)
    _KINDS[_c] = 6 if _c > 127 else 1 if _s.islower() else 2 if _s.isupper() else 3 if _s.isdigit() else 4 if _s.isspace() else 5 if _s in ".,;:?'\"-" else 0
NAMES = ["log_words", "other", "lower", "upper", "digit", "space", "sign", "foreign", "word_length", "distinct_words", "distinct_triples", "same_next", "top_word", "lines"]


def surface(data, offsets):
    """Rows x features of the texts."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    kinds = _KINDS[data]
    out = np.zeros((n, len(NAMES)))
    for kind in range(7):
        total = np.concatenate([[0], np.cumsum(kinds == kind)])
        out[:, 1 + kind] = np.diff(total[offsets]) / size
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    hashes, bounds = W.word_hashes(data, offsets)
    count = np.diff(bounds)
    out[:, 0] = np.log1p(count)
    out[:, 8] = np.log1p(np.diff(offsets) / np.maximum(count, 1))
    triples, triple_bounds = W.shingle_hashes(hashes, bounds, 3)
    equal = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) > 1:
        equal[1:-1] = hashes[1:] == hashes[:-1]
    equal[bounds] = 0
    out[:, 11] = np.diff(np.concatenate([[0], np.cumsum(equal[:-1])])[bounds]) / np.maximum(count, 1)
    out[:, 13] = np.diff(breaks[offsets]) / np.maximum(count, 1)
    for i in range(n):
        if count[i]:
            words = np.sort(hashes[bounds[i]:bounds[i + 1]])
            edges = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1], [True]]))
            out[i, 9] = (len(edges) - 1) / count[i]
            out[i, 12] = np.diff(edges).max() / count[i]
            out[i, 10] = len(W.distinct(triples[triple_bounds[i]:triple_bounds[i + 1]])) / (triple_bounds[i + 1] - triple_bounds[i])
    # repetition in relation to length: long texts repeat more words by nature
    out[:, 9] *= 1 + 0.1 * out[:, 0]
    return out


def _surfaces(batches):
    for batch in batches:
        data, offsets = W.column_bytes(batch.column(2))
        for low, high in W.slices(offsets, SLICE):
            values = surface(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
            rows = pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1, dtype=np.int32) * len(NAMES)), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(i).slice(low, high - low) for i in (0, 1)] + [rows], names=["doc_id", "hash", "values"])


def _binned(values, edges):
    """The column of each (row, feature) in the one-hot table of bins."""
    columns = np.empty(values.shape, np.int64)
    for j, cuts in enumerate(edges):
        columns[:, j] = j * BINS + np.searchsorted(cuts, values[:, j], "right")
    return columns


def _labelled(docs, labels):
    """(doc_id, label, values) of each labelled id that has a text: of rows that repeat it, the text with the smallest hash.

    Texts do not move. Those of few labels are picked out before they are measured; of many, after."""
    chosen = written(labelled_ids(labels, "quality"), "labels")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("hash"), F.col("text").cast("string").alias("text"))
    if is_small(chosen):
        texts = texts.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    measured = texts.where("doc_id IS NOT NULL").mapInArrow(_surfaces, "doc_id bigint, hash bigint, values array<double>")
    one = measured.groupBy("doc_id").agg(F.min_by("values", F.struct("hash", "values")).alias("values"))
    return written(one.join(chosen, "doc_id").select(F.col("doc_id").cast("bigint").alias("doc_id"), "label", "values"), "labelled")


def _matrix(column):
    """Rows x features of lists of one length, or of bytes of one length."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy().reshape(len(column), len(NAMES))
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), len(NAMES))


def _bins(edges):
    def run(batches):
        for batch in batches:
            bins = _binned(_matrix(batch.column(2)), edges).astype(np.uint8) if len(batch) else np.zeros((0, len(NAMES)), np.uint8)
            packed = pa.array([row.tobytes() for row in bins], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["doc_id", "label", "bins"])

    return run


def _differences(batch):
    """Better minus worse documents as rows of the table of bins."""
    better, worse = (_matrix(batch.column(i)) for i in (0, 1))
    for low in range(0, len(batch), PIECE):
        x = np.zeros((len(better[low:low + PIECE]), len(NAMES) * BINS))
        row = np.arange(len(x))[:, None]
        x[row, better[low:low + PIECE]] += 1
        x[row, worse[low:low + PIECE]] -= 1
        yield x, np.ones(len(x))


def _quantiles(table, column, n, shares, group):
    """group -> quantiles of its `n` values between the two that lie around each share, as numpy has them."""
    place = (n - 1) * shares
    low = np.floor(place)
    ranks = np.concatenate([low, np.ceil(place)])
    found = table.groupBy(group).agg(F.percentile_approx(column, [float(x) for x in (ranks + 0.5) / n], ACCURACY).alias("at")).collect()
    ends = {r[group]: np.array(r["at"]).reshape(2, -1) for r in found}
    return {key: least + (most - least) * (place - low) for key, (least, most) in ends.items()}


def _strengths(weights):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weights[_matrix(batch.column(1))].sum(axis=1))], names=["label", "strength"])

    return run


def _pairs(ranked, n0, n1):
    """(better, worse): each document of the larger class with PAIRS of the smaller one, which take turns. `ranked` has a class
    behind the other, in the order of hashes."""
    sides = [ranked.where(F.col("label") == k).select((F.col("rank") - k * n0).alias("at"), F.col("bins").alias(name)) for k, name in ((0, "worse"), (1, "better"))]
    few, many = sides if n0 <= n1 else sides[::-1]
    turns = F.explode(F.sequence(F.lit(0), F.lit(PAIRS - 1)))
    drawn = many.select(F.col(many.columns[1]), (F.col("at") * PAIRS).alias("_first"), turns.alias("_turn"))
    drawn = drawn.select(drawn.columns[0], F.pmod(F.col("_first") + F.col("_turn"), F.lit(min(n0, n1))).alias("at"))
    return drawn.join(broadcast_if_small(few), "at").select("better", "worse")


def train(docs, labels):
    """(bin edges, weights, strength that scores CUT, slope) from all labelled documents.

    `labels` has (doc_id, quality) of the rows to learn from. Without both labels every text has
    the score CUT.
    """
    rows = _labelled(docs, labels)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        return [np.zeros(0)] * len(NAMES), np.zeros(len(NAMES) * BINS), 0.0, 1.0
    # cuts at quantiles of both classes, so that a small class has bins of its own
    share = np.linspace(0, 1, BINS // 2 + 1)[1:-1]
    each = rows.select("label", F.posexplode("values").alias("feature", "value"))
    cuts = [_quantiles(each.where(F.col("label") == k), "value", n, share, "feature") for k, n in ((0, n0), (1, n1))]
    edges = [np.unique(np.concatenate([found[j] for found in cuts])) for j in range(len(NAMES))]
    binned = rows.mapInArrow(_bins(edges), "doc_id bigint, label int, bins binary")
    ranked = written(global_rank(binned.withColumn("hash", F.xxhash64("doc_id")), ["label", "hash", "doc_id"]).select("label", "rank", "bins"), "ranked")
    pairs = written(_pairs(ranked, n0, n1), "pairs")
    weights = fit_table(pairs, _differences, PAIRS * max(n0, n1), len(NAMES) * BINS, 1e-4)
    strengths = ranked.select("label", "bins").mapInArrow(_strengths(weights), "label int, strength double")
    middle = _quantiles(strengths.withColumn("all", F.lit(0)), "strength", n0 + n1, np.array([n0 / (n0 + n1)]), "all")[0][0]

    def line(batch):
        x = batch.column(1).to_numpy() - middle
        yield np.stack([x, np.ones(len(x))], axis=1), batch.column(0).to_numpy()

    slope = fit_table(strengths, line, n0 + n1, 2, 1e-4, free=1)[0]
    return edges, weights, float(middle), float(max(slope, 1e-3))


def _scores(edges, weights, middle, slope):
    shift = np.log(CUT / (1 - CUT))

    def run(batches):
        for batch in batches:
            data, offsets = W.column_bytes(batch.column(1))
            for low, high in W.slices(offsets, SLICE):
                values = surface(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                strength = weights[_binned(values, edges)].sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(sigmoid(slope * (strength - middle) + shift)), pa.array(strength)],
                    names=["doc_id", "score", "strength"],
                )

    return run


def score(docs, model):
    """One row per row of `docs` (doc_id, text): doc_id, score (0 to 1, higher is better), strength.

    Null and empty texts have all features 0. Repeated rows each get a row; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scores(*model), "doc_id bigint, score double, strength double")
