"""Benchmark items in documents by SimHash of item-sized windows.

Words are lower-cased letters and digits; an item is the multiset of its `SIZE`-word shingles, and a
document is looked at through windows of as many shingles as an item has. A window and an item can only be
similar if they share a shingle, so windows are made around shared shingles alone. Their 128-bit
fingerprints come from running sums over the document. A fingerprint within `RADIUS` bits of an item's agrees
with it up to `RADIUS // BLOCKS` bits in at least one of `BLOCKS` blocks; tables per block value therefore
list every item within the radius, and no other comparison is made. Candidates are verified by the weighted
similarity (sum of the smaller over sum of the larger counts).

Windows at the limit similarity of 0.8 differ from the item in 19.4 of 128 bits on average (standard
deviation 4.1); the radius of 36 lies four deviations above.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridprep.llm import words as W
from gridprep.llm.tables import written

SIZE = 5
BITS = 128
RADIUS = 36
BLOCKS = 16
WORDS_PER_PASS = 1_000_000  # words of benchmark items that one pass over the documents carries
SLICE = 1 << 20
REGION = 1 << 14

_SEEDS = np.random.default_rng(3).integers(1, 1 << 63, BITS // 64, dtype=np.uint64)
_BIT_COUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _signs(shingles):
    """+1 or -1 for each shingle and bit."""
    bits = np.concatenate([W.mix(shingles ^ seed)[:, None].view(np.uint8) for seed in _SEEDS], axis=1)
    return np.unpackbits(bits, axis=1).astype(np.int8) * 2 - 1


def _packed(sums):
    return np.packbits(sums > 0, axis=-1)


def fingerprint(shingles):
    return _packed(_signs(shingles).sum(axis=0, dtype=np.int32)[None, :])[0]


def near(a, b):
    """How many bits differ between fingerprints."""
    return _BIT_COUNT[a ^ b].sum(axis=-1, dtype=np.int32)


def similarity(a, b):
    """Weighted similarity of two multisets of shingles."""
    a, b = Counter(a), Counter(b)
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


class Items:
    """Benchmark items and the tables that find them."""

    def __init__(self, ids, texts):
        data, offsets = W.column_bytes(pa.array(texts, pa.string()))
        hashes, bounds = W.word_hashes(data, offsets, letters_only=True)
        shingles, bounds = W.shingle_hashes(hashes, bounds, SIZE)
        kept = [i for i in range(len(ids)) if bounds[i + 1] > bounds[i]]
        self.ids = [ids[i] for i in kept]
        self.shingles = [shingles[bounds[i]:bounds[i + 1]] for i in kept]
        self.counts = [Counter(s.tolist()) for s in self.shingles]
        sizes = np.array([len(s) for s in self.shingles], np.int64)
        self.prints = np.array([fingerprint(s) for s in self.shingles], np.uint8).reshape(len(kept), BITS // 8)
        # shingle -> sizes of the items that hold it
        pairs = sorted({(int(h), int(n)) for s, n in zip(self.shingles, sizes) for h in s})
        self.keys = np.array([h for h, _ in pairs], np.uint64)
        self.key_sizes = np.array([n for _, n in pairs], np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.keys & np.uint64((1 << 20) - 1)] = True
        self.by_size = {}
        differ = _BIT_COUNT[np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]]
        for n in np.unique(sizes):
            members = np.flatnonzero(sizes == n)
            # for each block and value of a window's block: which items may be near
            tables = np.stack([differ[:, self.prints[members, block]] <= RADIUS // BLOCKS for block in range(BLOCKS)])
            self.by_size[int(n)] = members, tables

    def anchors(self, shingles):
        """(place, size of an item that holds the shingle there) for the shingles of a document."""
        at = np.flatnonzero(self.seen[shingles & np.uint64((1 << 20) - 1)])
        low, high = np.searchsorted(self.keys, shingles[at], "left"), np.searchsorted(self.keys, shingles[at], "right")
        found = high - low
        place = np.repeat(at, found)
        index = np.repeat(low - np.concatenate([[0], np.cumsum(found)[:-1]]) if len(found) else low, found) + np.arange(found.sum())
        return place, self.key_sizes[index]

    def candidates(self, size, prints):
        """(window, item) pairs within the radius."""
        members, tables = self.by_size[size]
        near_block = np.zeros((len(prints), len(members)), bool)
        for block in range(BLOCKS):
            near_block |= tables[block][prints[:, block]]
        window, member = np.nonzero(near_block)
        close = near(prints[window], self.prints[members[member]]) <= RADIUS
        return window[close], members[member[close]]

    def matches(self, shingles, least):
        """For each item found in a document: item -> (similarity, first shingle of the best window)."""
        place, sizes = self.anchors(shingles)
        best = {}
        for size in np.unique(sizes):
            size = int(size)
            near_places = place[sizes == size]
            last = max(len(shingles) - size, 0)
            # starts of the windows that hold a shared shingle
            change = np.zeros(last + 2, np.int32)
            np.add.at(change, np.clip(near_places - size + 1, 0, last), 1)
            np.add.at(change, np.minimum(near_places, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(change[:-1]) > 0)
            for low in range(0, len(starts), REGION):
                some = starts[low:low + REGION]
                # runs of starts that follow each other share their running sums
                for run in np.split(some, np.flatnonzero(np.diff(some) > size) + 1):
                    end = min(int(run[-1]) + size, len(shingles))
                    sums = np.zeros((end - run[0] + 1, BITS), np.int32)
                    np.cumsum(_signs(shingles[run[0]:end]), axis=0, dtype=np.int32, out=sums[1:])
                    inside = run - run[0]
                    prints = _packed(sums[np.minimum(inside + size, end - run[0])] - sums[inside])
                    for window, item in zip(*self.candidates(size, prints)):
                        start = int(run[window])
                        counts = Counter(shingles[start:start + size].tolist())
                        both = sum((counts & self.counts[item]).values())
                        alike = both / (min(size, len(shingles) - start) + size - both)
                        if alike >= least and (item not in best or alike > best[item][0]):
                            best[item] = alike, start
        return best


def _find(items, least):
    def run(batches):
        for batch in batches:
            data, offsets = W.column_bytes(batch.column(1))
            ids = batch.column(0)
            rows, item, alike, start, size = [], [], [], [], []
            for low, high in W.slices(offsets, SLICE):
                hashes, bounds = W.word_hashes(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], letters_only=True)
                shingles, bounds = W.shingle_hashes(hashes, bounds, SIZE)
                hit = np.flatnonzero(items.seen[shingles & np.uint64((1 << 20) - 1)])
                for i in np.unique(np.searchsorted(bounds, hit, "right") - 1):
                    for j, (a, s) in items.matches(shingles[bounds[i]:bounds[i + 1]], least).items():
                        rows.append(low + int(i))
                        item.append(items.ids[j])
                        alike.append(a)
                        start.append(s)
                        size.append(len(items.shingles[j]))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), pa.array(item, pa.int64()), pa.array(alike, pa.float64()), pa.array(start, pa.int64()), pa.array(size, pa.int64())],
                names=["doc_id", "item_id", "similarity", "start", "shingles"],
            )

    return run


def item_blocks(benchmark, most=WORDS_PER_PASS):
    """The items in blocks of at most about `most` words; only one block is on the driver at a time."""
    ids, texts, held = [], [], 0
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text"))
    for row in rows.orderBy("item_id").toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        held += row.text.count(" ") + 1
        if held >= most:
            yield Items(ids, texts)
            ids, texts, held = [], [], 0
    if ids:
        yield Items(ids, texts)


def contaminated(docs, benchmark, least=0.8, words_per_pass=WORDS_PER_PASS):
    """One row per document and item it holds: doc_id, item_id, similarity, start, shingles.

    `docs` has (doc_id, text), `benchmark` (item_id, text). `similarity` is that of the best window (the first
    of equal ones), `start` its first shingle, `shingles` its length. A text of fewer than five words is one
    shingle; null and wordless texts match nothing. Items are sent to the tasks in blocks of bounded size,
    with one pass over the documents for each. A row that repeats a doc_id or an item_id is matched by
    itself and the best match of each pair of ids is returned. Null ids take no part.
    """
    text = F.lower(F.col("text").cast("string"))
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    schema = "doc_id bigint, item_id bigint, similarity double, start bigint, shingles bigint"
    found = docs.sparkSession.createDataFrame([], schema)
    for items in item_blocks(benchmark, words_per_pass):
        if items.ids:
            # written at once, so that the driver keeps no block's tables
            found = found.unionByName(written(rows.mapInArrow(_find(items, least), schema), "matches"))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), "shingles")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.similarity", (-F.col("best.start")).alias("start"), "best.shingles"
    )
