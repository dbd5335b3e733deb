"""Spelling variants: words one edit apart, grouped under the far more frequent form, by k-d trees.

A word becomes the vector of its letter counts (code points folded to `DIMENSIONS`). One inserted or deleted letter changes
one count by one, a replaced one at most two, so near words are at most 2 apart in L1 distance: between equal lengths
one count may rise by one and one fall by one, towards the next length one may rise.

The top of the k-d tree of each length is fitted on a bounded sample of words and cuts all words into cells; cells
whose boxes are too far apart never meet. A cell of more than `CELL` words is cut by hash into parts. Each pair of
parts that remains is one task's work of bounded size: a k-d tree over the one, range searches of the other that prune
by the boxes of the nodes, and a comparison letter by letter.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridprep.llm.tables import written
from gridprep.operators.joins import broadcast_if_small

LETTERS = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
DIMENSIONS = 32
MOST_COUNT = 127  # larger counts count as this: distances only get smaller
SAMPLE = 200_000  # words that place the cells; all words are put into them
CELL, CELL_LETTERS = 16_384, 1 << 22
MOST_CELLS = 4096
LEAF = 48
HELD = 200_000  # words counted by a task before they are handed on
SLICE = 1 << 20
PAIR_LETTERS = 1 << 22
MOST_SENT_PAIRS = 1_000_000


def _runs(text, least):
    """The runs of at least `least` letters of a text, some of it at a time."""
    pattern = re.compile(f"{LETTERS.pattern[:-1]}{{{least},}}")
    low = 0
    while low < len(text):
        high = low + SLICE
        while high < len(text) and LETTERS.match(text, high):
            high = LETTERS.match(text, high).end()
        yield pattern.findall(text, low, min(high, len(text)))
        low = high


def _counts(least_length, misspell):
    def run(batches):
        total = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = (text.as_py() or "").encode().translate(_LOWER).decode()
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for words in _runs(text, least_length):
                    for word, n in Counter(words).items():
                        if misspell:
                            h = zlib.crc32(word.encode(), start)
                            if h % misspell == 0:
                                word = word[:h % len(word)] + word[h % len(word) + 1:]
                                if len(word) < least_length:
                                    continue
                        total[word] += n
                if len(total) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(total.keys()), pa.array(total.values(), pa.int64())], names=["word", "n"])
                    total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    return run


def word_counts(docs, least_length=6, least_count=5, misspell=None):
    """(word, n) of the runs of letters (A-Z, a-z, U+00C0-00FF; A-Z lower-cased) in all texts of (doc_id, text).

    Words have at least `least_length` code points and `least_count` occurrences. With `misspell`, a run loses the code point
    h % length if `misspell` divides h, the CRC-32 of `<doc_id>:<run>`; a null doc_id is empty. Null texts hold no words.
    """
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.mapInArrow(_counts(least_length, misspell), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= least_count)


def code_points(words):
    """The code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def letter_counts(points):
    """Folded letter counts of rows of code points."""
    out = np.empty((len(points), DIMENSIONS), np.int16)
    step = max(1, PAIR_LETTERS // max(1, points.shape[1]))
    for low in range(0, len(points), step):
        some = points[low:low + step] % DIMENSIONS
        place = some + (np.arange(len(some)) * DIMENSIONS)[:, None]
        counts = np.bincount(place.ravel(), minlength=len(some) * DIMENSIONS).reshape(-1, DIMENSIONS)
        out[low:low + step] = np.minimum(counts, MOST_COUNT)
    return out


def _split(vectors):
    """(dimension, threshold) that cut vectors most evenly into counts up to the threshold and above, or None."""
    best = None
    for d in range(vectors.shape[1]):
        column = vectors[:, d]
        tally = np.cumsum(np.bincount(column))[:-1]
        if len(tally):
            at = int(np.abs(2 * tally - len(column)).argmin())
            lopsided = abs(2 * int(tally[at]) - len(column))
            if 0 < tally[at] < len(column) and (best is None or lopsided < best[0]):
                best = (lopsided, d, at)
    return best and best[1:]


class Cells:
    """The top of one length's k-d tree: a list of nodes (dimension, threshold, left, right) and the boxes of its leaves."""

    def __init__(self, vectors, leaves):
        self.nodes, self.low, self.high = [], [], []
        self._grow(vectors, leaves, np.zeros(DIMENSIONS, np.int16), np.full(DIMENSIONS, MOST_COUNT, np.int16))

    def _grow(self, vectors, leaves, low, high):
        split = _split(vectors) if leaves > 1 and len(vectors) > 1 else None
        if split is None:
            self.low.append(low)
            self.high.append(high)
            return -len(self.low)
        d, at = split
        place = len(self.nodes)
        self.nodes.append(None)
        below = vectors[:, d] <= at
        left_high, right_low = high.copy(), low.copy()
        left_high[d], right_low[d] = at, at + 1
        left = self._grow(vectors[below], leaves / 2, low, left_high)
        self.nodes[place] = (d, at, left, self._grow(vectors[~below], leaves / 2, right_low, high))
        return place

    def place(self, vectors):
        """The leaf of each vector."""
        out = np.zeros(len(vectors), np.int32)
        waiting = [(0 if self.nodes else -1, np.arange(len(vectors)))]
        while waiting:
            node, rows = waiting.pop()
            if node < 0:
                out[rows] = -node - 1
            else:
                d, at, left, right = self.nodes[node]
                below = vectors[rows, d] <= at
                waiting += [(left, rows[below]), (right, rows[~below])]
        return out


def _reach(low, high, vectors_low, vectors_high, grown):
    """Whether boxes hold vectors one edit apart: from the second boxes to (low, high), one letter longer if `grown`."""
    up = np.maximum(low - vectors_high, 0).sum(axis=-1)
    down = np.maximum(vectors_low - high, 0).sum(axis=-1)
    return (up <= 1) & (down <= (0 if grown else 1))


def fit_cells(words):
    """{length: Cells} from a sample of at most `SAMPLE` words (word, n), chosen by hash."""
    total = words.count()
    rate = min(1.0, SAMPLE * 0.98 / max(1, total))
    chosen = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(rate * (1 << 30))).select("word").limit(SAMPLE).toArrow()
    by_length = {}
    for word in chosen.column(0).to_pylist():
        by_length.setdefault(len(word), []).append(word)
    size = max(CELL, total / MOST_CELLS)
    return {n: Cells(letter_counts(code_points(some)), len(some) / rate / size) for n, some in sorted(by_length.items())}


ONE_CELL = Cells(np.zeros((0, DIMENSIONS), np.int16), 0)


def _placed(cells):
    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            lengths = np.fromiter(map(len, words), np.int32, len(words))
            cell = np.zeros(len(words), np.int32)
            for n in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == n)
                step = max(1, PAIR_LETTERS // max(1, n))
                for low in range(0, len(rows), step):
                    some = rows[low:low + step]
                    cell[some] = cells.get(n, ONE_CELL).place(letter_counts(code_points([words[i] for i in some])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths), pa.array(cell)], names=["word", "n", "length", "cell"])

    return run


def _cell_pairs(cells, lengths):
    """(length, cell, other length, other cell) of all cells that may hold near words, each two once."""
    pairs = []
    for n in lengths:
        own = cells.get(n, ONE_CELL)
        for longer in (n, n + 1):
            if longer not in lengths:
                continue
            other = cells.get(longer, ONE_CELL)
            low, high = np.array(other.low), np.array(other.high)
            for i in range(len(own.low)):
                near = np.flatnonzero(_reach(low, high, own.low[i], own.high[i], longer > n))
                pairs += [(n, i, longer, int(j)) for j in near if longer > n or j >= i]
    return pairs


class Tree:
    """A k-d tree over letter-count vectors with the bounding box of every node."""

    def __init__(self, vectors):
        self.order, self.nodes = np.arange(len(vectors)), []
        self._grow(vectors, 0, len(vectors))

    def _grow(self, vectors, start, end):
        rows = self.order[start:end]
        some = vectors[rows]
        place = len(self.nodes)
        self.nodes.append(None)
        split = _split(some) if end - start > LEAF else None
        children = None
        if split is not None:
            below = some[:, split[0]] <= split[1]
            middle = start + int(below.sum())
            self.order[start:end] = np.concatenate([rows[below], rows[~below]])
            children = self._grow(vectors, start, middle), self._grow(vectors, middle, end)
        self.nodes[place] = (some.min(axis=0), some.max(axis=0), start, end, children)
        return place

    def search(self, vectors, grown):
        """Yield (queries, points) of every leaf in reach: arrays of places in `vectors` and in the tree's own."""
        waiting = [(0, np.arange(len(vectors)))]
        while waiting:
            node, queries = waiting.pop()
            low, high, start, end, children = self.nodes[node]
            some = vectors[queries]
            queries = queries[_reach(low, high, some, some, grown)]
            if not len(queries):
                continue
            if children is None:
                yield queries, self.order[start:end]
            else:
                waiting += [(child, queries) for child in children]


def _unary(vectors):
    """Counts up to 2 of each dimension as bits: two words' codes differ in at most as many bits as their distance."""
    bits = np.zeros(len(vectors), np.uint64)
    for d in range(DIMENSIONS):
        bits |= ((vectors[:, d] > 0).astype(np.uint64) | ((vectors[:, d] > 1).astype(np.uint64) << np.uint64(1))) << np.uint64(2 * d)
    return bits


def _one_edit(a, b):
    """Whether rows of code points are one edit apart, letter by letter; `b` is as long or one longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    ones = np.ones((len(a), 1), bool)
    front = np.hstack([a != b[:, :-1], ones]).argmax(axis=1)  # letters in common at the front
    back = np.hstack([(a != b[:, 1:])[:, ::-1], ones]).argmax(axis=1)
    return front + back >= a.shape[1]


def near_pairs(words, others):
    """Yield arrays (i, j): words[i] and others[j], of the same length or one longer, are one edit apart.

    `others` may be `words` itself: then every pair comes once."""
    a, b = code_points(words), code_points(others)
    x, y = letter_counts(a), letter_counts(b)
    grown, own = b.shape[1] > a.shape[1], words is others
    codes, other_codes = _unary(x), _unary(y)
    step = max(1, PAIR_LETTERS // max(1, b.shape[1]))
    for queries, points in Tree(y).search(x, grown):
        close = np.bitwise_count(codes[queries][:, None] ^ other_codes[points][None, :]) <= (1 if grown else 2)
        if own:
            close &= queries[:, None] < points[None, :]
        i, j = np.nonzero(close)
        i, j = queries[i], points[j]
        for low in range(0, len(i), step):
            near = _one_edit(a[i[low:low + step]], b[j[low:low + step]])
            yield i[low:low + step][near], j[low:low + step][near]


NEAR = "word string, n_near bigint, form string, form_n bigint"


def _best(rows):
    """Of the words of one pair of parts: how many near words each has there, and the most frequent of them."""
    side = rows.column("other").to_numpy()
    words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    own, other = np.flatnonzero(~side), np.flatnonzero(side)
    first = [words[i] for i in own]
    second, other = (first, own) if not len(other) and rows.column("same")[0].as_py() else ([words[i] for i in other], other)
    if not first or not second:
        return pa.Table.from_batches([], pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())]))
    found = [(own[i], other[j]) for i, j in near_pairs(first, second)]
    a = np.concatenate([p[0] for p in found] + [np.empty(0, np.int64)]).astype(np.int64)
    b = np.concatenate([p[1] for p in found] + [np.empty(0, np.int64)]).astype(np.int64)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
    counts = np.diff(np.concatenate([starts, [len(a)]]))
    return pa.table({
        "word": pa.array([words[i] for i in a[starts]], pa.string()), "n_near": pa.array(counts.astype(np.int64)),
        "form": pa.array([words[i] for i in b[starts]], pa.string()), "form_n": pa.array(n[b[starts]].astype(np.int64)),
    })


def _near(words):
    """(word, n_near, form, form_n) of the words (word, n) that have near words: how many, and the most frequent one."""
    spark = words.sparkSession
    cells = fit_cells(words)
    placed = written(words.mapInArrow(_placed(cells), "word string, n bigint, length int, cell int"), "placed")
    share = F.greatest(F.count("*") / CELL, F.count("*") * F.col("length") / CELL_LETTERS)
    sizes = placed.groupBy("length", "cell").agg(F.ceil(share).cast("int").alias("parts"))
    sizes = written(sizes, "sizes")
    lengths = {r["length"] for r in sizes.select("length").distinct().collect()}
    pairs = spark.createDataFrame(_cell_pairs(cells, lengths), "length int, cell int, to_length int, to_cell int")
    to_sizes = sizes.withColumnsRenamed({"length": "to_length", "cell": "to_cell", "parts": "to_parts"})
    units = pairs.join(sizes, ["length", "cell"]).join(to_sizes, ["to_length", "to_cell"])
    units = units.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("to_part", F.explode(F.sequence(F.lit(0), F.col("to_parts") - 1)))
    one_cell = (F.col("length") == F.col("to_length")) & (F.col("cell") == F.col("to_cell"))
    units = written(
        units.where(~one_cell | (F.col("part") <= F.col("to_part")))
        .select("length", "cell", "part", "to_length", "to_cell", "to_part", (one_cell & (F.col("part") == F.col("to_part"))).alias("same"))
        .withColumn("unit", F.monotonically_increasing_id()), "units",
    )
    parted = placed.join(F.broadcast(sizes), ["length", "cell"]).withColumn("part", F.pmod(F.xxhash64("word"), "parts").cast("int"))
    key = ["length", "cell", "part"]
    ends = units.select(*key, "unit", "same", F.lit(False).alias("other")).unionByName(
        units.where("NOT same").select(*[F.col(f"to_{c}").alias(c) for c in key], "unit", "same", F.lit(True).alias("other")))
    rows = parted.join(broadcast_if_small(ends, MOST_SENT_PAIRS), key).select("unit", "same", "other", "word", "n")
    return rows.groupBy("unit").applyInArrow(_best, NEAR)


def _roots(forms):
    """(word, root) of words with a form (word, form): where their forms lead. Forms grow in frequency, so there are no rings."""
    ways = written(forms, "ways")
    while True:
        onward = ways.select(F.col("word").alias("form"), F.col("form").alias("_next"))
        stepped = written(ways.join(onward, "form", "left").select("word", F.coalesce("_next", "form").alias("form"), F.col("_next").isNotNull().alias("moved")), "ways")
        ways = stepped.select("word", "form")
        if stepped.where("moved").isEmpty():
            return ways.withColumnRenamed("form", "root")


def group_variants(words, factor=5):
    """One row per row of `words` (word, n): word, form, root, n, n_near, form_n.

    Words are near if one inserted, deleted or replaced code point makes them equal; `n_near` counts a word's near words. Its form
    is the most frequent of them (of equally frequent ones the first in code-point order) if that is at least `factor` times
    as frequent as the word, else null; `root` is where the forms lead, the word itself if it has none. Words must be
    distinct and not null; other columns are ignored and an empty table gives an empty result.
    """
    words = written(words.select("word", F.col("n").cast("bigint").alias("n")), "words")
    best = F.min(F.struct((-F.col("form_n")).alias("o"), "form"))
    near = _near(words).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    far_more = -F.col("b.o") >= factor * F.col("n")
    formed = written(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(far_more, F.col("b.form")).alias("form"), F.when(far_more, -F.col("b.o")).alias("form_n")), "formed",
    )
    roots = _roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
