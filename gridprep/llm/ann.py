"""Approximate nearest neighbours by collision-counting hashing (query-aware projections).

Each vector is projected on `PROJECTIONS` random lines, and a block of vectors keeps one sorted array per
line. For a query the window around its own projection grows on all lines at once, by a factor of
`GROWTH` per round (virtual rehashing: no table is rebuilt); a vector that lies in the windows of at
least `THRESHOLD` lines is verified by its true distance. A query is done when its k-th verified
distance is within the round's radius.

The window's half-width is the radius, so a vector at that distance lies in a window with probability 0.683;
of 64 lines 43.7 on average, with a standard deviation of 3.7. The threshold of 36 lies two
deviations below. Blocks are searched independently and their best k are merged, so the result
does not depend on how rows are spread; queries go to the tasks in blocks of bounded size.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from gridprep.llm.tables import written

PROJECTIONS = 64
THRESHOLD = 36
GROWTH = 1.3
BLOCK_ROWS = 16_384
QUERY_NUMBERS = 4_000_000  # vector components of the queries of one pass


def usable(vectors):
    """Rows whose vector takes part: (vec_id, embedding as doubles) without null, zero or non-finite vectors."""
    values = F.col("embedding").cast("array<double>")
    good = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), values.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & good & F.exists("embedding", lambda x: x != 0)
    )


def lines(dimensions):
    return np.random.default_rng(dimensions).standard_normal((dimensions, PROJECTIONS))


def distances(vectors, query):
    """Euclidean distances in double precision."""
    return np.sqrt(((vectors - query) ** 2).sum(axis=1))


class Block:
    """Some vectors and their sorted projections."""

    def __init__(self, ids, vectors):
        self.ids, self.vectors = ids, vectors
        projected = vectors @ lines(vectors.shape[1])
        self.order = np.ascontiguousarray(np.argsort(projected, axis=0, kind="stable").T).astype(np.int32)
        self.sorted = [projected[o, i] for i, o in enumerate(self.order)]
        spread = np.array([s[-1] - s[0] for s in self.sorted])
        self.widest = spread.max()

    def search(self, query_id, query, projected, k, radius):
        """(index, distance) of the nearest verified vectors, the query's own row left out."""
        n = len(self.ids)
        others = n - int((self.ids == query_id).sum())
        hits = np.zeros(n, np.uint8)
        checked = np.zeros(n, bool)
        checked[self.ids == query_id] = True
        found_at, found = [], []
        centers = [int(np.searchsorted(s, p)) for s, p in zip(self.sorted, projected)]
        low, high = list(centers), list(centers)
        k = min(k, others)
        far = self.widest + max(abs(p - s[0]) for p, s in zip(projected, self.sorted))
        while k:
            for i, s in enumerate(self.sorted):
                a, b = np.searchsorted(s, (projected[i] - radius, projected[i] + radius))
                a, b = min(a, low[i]), max(b, high[i])
                if a < low[i]:
                    hits[self.order[i, a:low[i]]] += 1
                if b > high[i]:
                    hits[self.order[i, high[i]:b]] += 1
                low[i], high[i] = a, b
            new = np.flatnonzero((hits >= THRESHOLD) & ~checked)
            if len(new):
                checked[new] = True
                found_at.append(new)
                found.append(distances(self.vectors[new], query))
                if sum(map(len, found)) >= k and np.partition(np.concatenate(found), k - 1)[k - 1] <= radius:
                    break
            if radius > far:  # every vector lies in every window
                break
            radius *= GROWTH
        if not found:
            return np.empty(0, np.int64), np.empty(0)
        return np.concatenate(found_at), np.concatenate(found)


def _first_radius(vectors, sample=64):
    """Half the smallest distance between a few vectors; only the number of rounds depends on it."""
    some = vectors[:: max(1, len(vectors) // sample)][:sample]
    gaps = np.concatenate([distances(some[i + 1:], some[i]) for i in range(len(some))]) if len(some) > 1 else np.empty(0)
    gaps = gaps[gaps > 0]
    return max(float(gaps.min()) / 2 if len(gaps) else 1.0, 1e-9)


def _merged(batches):
    """Blocks of rows of one length each."""
    held = {}
    for row_ids, lists in batches:
        sizes = lists.value_lengths().to_numpy()
        flat = lists.flatten().to_numpy()
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            values = flat[(starts[rows][:, None] + np.arange(size))].astype(np.float64)
            kept = held.setdefault(int(size), [[], [], 0])
            kept[0].append(row_ids[rows])
            kept[1].append(values)
            kept[2] += len(rows)
            if kept[2] >= BLOCK_ROWS:
                yield np.concatenate(kept[0]), np.concatenate(kept[1])
                held[int(size)] = [[], [], 0]
    for parts in held.values():
        if parts[2]:
            yield np.concatenate(parts[0]), np.concatenate(parts[1])


def _search(queries, k):
    def run(batches):
        rows = ((b.column(0).to_numpy(), b.column(1)) for b in batches)
        for ids, vectors in _merged(rows):
            if vectors.shape[1] not in queries:
                continue
            query_ids, points = queries[vectors.shape[1]]
            block = Block(ids, vectors)
            projected = points @ lines(vectors.shape[1])
            radius = _first_radius(vectors)
            out = [[], [], []]
            for q, (query_id, query) in enumerate(zip(query_ids, points)):
                at, score = block.search(query_id, query, projected[q], k, radius)
                if len(at) > k:
                    limit = np.partition(score, k - 1)[k - 1]
                    near = score <= limit
                    at, score = at[near], score[near]
                best = np.lexsort((ids[at], score))[:k]
                out[0].append(np.full(len(best), query_id))
                out[1].append(ids[at[best]])
                out[2].append(score[best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out[0]).astype(np.int64)), pa.array(np.concatenate(out[1]).astype(np.int64)), pa.array(np.concatenate(out[2]).astype(np.float64))],
                names=["query_id", "vec_id", "score"],
            )

    return run


def _query_blocks(queries, numbers):
    """The queries by vector length, in blocks of at most about `numbers` components; one at a time is on the driver."""
    held, size = {}, 0
    for row in queries.toLocalIterator():
        ids, points = held.setdefault(len(row.embedding), ([], []))
        ids.append(row.vec_id)
        points.append(row.embedding)
        size += len(row.embedding)
        if size >= numbers:
            yield held
            held, size = {}, 0
    if held:
        yield held


def nearest(vectors, queries, k=10, numbers=QUERY_NUMBERS):
    """The `k` nearest found of each query: query_id, rank (from 1), vec_id, score (Euclidean distance).

    `vectors` and `queries` have (vec_id, embedding). A query's own vec_id is no candidate, and only vectors
    of its length are. Null, zero and non-finite vectors take no part, and neither do null ids. Ties go to
    the smaller vec_id. Rows that repeat a vec_id are candidates of their own; of queries that repeat one, that
    with the smallest vector is searched. Fewer than `k` candidates are all returned. Other columns are ignored.
    """
    rows = usable(vectors)
    schema = "query_id bigint, vec_id bigint, score double"
    found = vectors.sparkSession.createDataFrame([], schema)
    queries = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    for block in _query_blocks(queries, numbers):
        held = {size: (np.array(ids, np.int64), np.array(points, np.float64)) for size, (ids, points) in block.items()}
        found = found.unionByName(written(rows.mapInArrow(_search(held, k), schema), "found"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
