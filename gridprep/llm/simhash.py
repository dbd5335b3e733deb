"""Near duplicates by SimHash and BK-trees.

A document's fingerprint has a bit set where more than half of the XXH64 hashes of its word shingles, repeats
included, have it. Fingerprints are linked if they differ in at most `radius` bits.

A BK-tree keeps the children of a node under their Hamming distance to it, so a search for all fingerprints within
a radius of a query at distance d follows the edges d - radius to d + radius only. Its two top levels are
the same for all fingerprints: the distances to two fixed pivots name a cell, and each cell is cut by hash into shards of
about `SHARD` fingerprints, each with a tree of its own. The trees go to all tasks in passes of at most `PASS_BYTES`, and
a shard's fingerprints are searched in the trees of the 25 cells within the radius (of each two cells, in one).

A shard pair gives a spanning forest of its links instead of all of them: at most one row for each fingerprint,
with the same components, however many near copies meet there.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from gridprep.llm.components import components
from gridprep.llm.tables import written
from gridprep.operators.joins import join_unique
from gridprep.session import shuffle_partitions

BITS = 64
SEED = 42
PIVOTS = (0, 0x9E3779B97F4A7C15)
SHARD = 32_768
NODE_BYTES = 16
PASS_BYTES = 32 << 20
FRONTIER = 1 << 20
QUERIES = 4096
SLICE = 4 << 20
MOST_SENT_IDS = 1_000_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLANK = re.compile(rb"[ \t-\r]")


def _word_slices(data):
    """The words of a text, some megabytes at a time."""
    low = 0
    while low < len(data):
        high = low + SLICE
        if high < len(data):
            blank = _BLANK.search(data, high)
            high = blank.start() if blank else len(data)
        yield data[low:high].split()
        low = high


def fingerprint(text, size=3):
    """The SimHash of a text's shingles of `size` words; of its whole sequence if it has fewer, 0 if it has none."""
    ones, n, words = np.zeros(BITS, np.int64), 0, []
    for more in _word_slices((text or "").encode().translate(_LOWER)):
        words += more
        if len(words) >= size:
            joined = b" ".join(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(lengths + 1) - 1
            starts = (ends - lengths)[:len(words) - size + 1].tolist()
            hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1:].tolist())]
            ones += _bit_sums(hashes)
            n += len(hashes)
            words = words[len(words) - size + 1:]
    if n == 0 and words:
        ones, n = _bit_sums([xxhash.xxh64_intdigest(b" ".join(words), SEED)]), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _bit_sums(hashes):
    total = np.zeros(BITS, np.int64)
    values = np.array(hashes, np.uint64)
    for low in range(0, len(values), 1 << 16):
        bits = np.unpackbits(values[low:low + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, BITS)
        total += bits.sum(axis=0, dtype=np.int64)
    return total


def _fingerprints(size):
    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    return run


def build_tree(values):
    """(fingerprints in node order, edges): node i + 1 hangs on the edge edges[i] = parent * 65 + distance to the parent.

    Nodes are numbered level by level, so the edges are sorted and a node's children are a range of them."""
    nodes, edges, made = [values[:1]], [], 1
    rest = values[1:]
    parent, at = np.zeros(len(rest), np.int64), np.repeat(values[:1], len(rest))
    while len(rest):
        edge = parent * (BITS + 1) + np.bitwise_count(rest ^ at)
        order = np.argsort(edge, kind="stable")
        edge, rest = edge[order], rest[order]
        first = np.concatenate([[True], edge[1:] != edge[:-1]])
        place = np.cumsum(first) - 1
        nodes.append(rest[first])
        edges.append(edge[first])
        parent, at = (made + place)[~first], rest[first][place][~first]
        rest = rest[~first]
        made += int(first.sum())
    return np.concatenate(nodes), np.concatenate(edges) if edges else np.empty(0, np.int64)


def search_tree(nodes, edges, queries, radius):
    """Yield arrays (query, node) of all pairs within the radius, following only edges within it."""
    waiting = [(np.arange(low, min(low + QUERIES, len(queries))), None) for low in range(0, len(queries), QUERIES)]
    while waiting:
        query, node = waiting.pop()
        if node is None:
            node = np.zeros(len(query), np.int64)
        if len(query) > FRONTIER:
            half = len(query) // 2
            waiting += [(query[:half], node[:half]), (query[half:], node[half:])]
            continue
        distance = np.bitwise_count(queries[query] ^ nodes[node]).astype(np.int64)
        near = distance <= radius
        yield query[near], node[near]
        low = np.searchsorted(edges, node * (BITS + 1) + np.maximum(distance - radius, 0))
        high = np.searchsorted(edges, node * (BITS + 1) + np.minimum(distance + radius, BITS), "right")
        counts = high - low
        total = int(counts.sum())
        if total:
            before = np.repeat(np.cumsum(counts) - counts, counts)
            waiting.append((np.repeat(query, counts), np.repeat(low, counts) + np.arange(total) - before + 1))


def _joined(labels, a, b):
    """The labels after the links (a, b): each component has its smallest index."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            higher = labels[labels]
            if (higher == labels).all():
                break
            labels = higher


def _forests(radius):
    def run(batches):
        for batch in batches:
            for own, nodes, edges, same in zip(*(batch.column(c).to_pylist() for c in ("own", "nodes", "edges", "same"))):
                own, nodes, edges = np.frombuffer(own, np.uint64), np.frombuffer(nodes, np.uint64), np.frombuffer(edges, np.int64)
                every = nodes if same else np.concatenate([nodes, own])
                labels = np.arange(len(every))
                for query, node in search_tree(nodes, edges, own, radius):
                    labels = _joined(labels, query if same else query + len(nodes), node)
                linked = np.flatnonzero(labels != np.arange(len(every)))
                ends = every[linked].view(np.int64), every[labels[linked]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e) for e in ends], names=["a", "b"])

    return run


def _tree_row(key, rows):
    nodes, edges = build_tree(np.sort(rows.column("fingerprint").to_numpy().view(np.uint64)))
    values = [[k] for k in key] + [[nodes.tobytes()], [edges.tobytes()]]
    return pa.table([*[pa.array(v, pa.int32()) for v in values[:3]], *[pa.array(v, pa.binary()) for v in values[3:]]],
                    names=["x", "y", "part", "nodes", "edges"])


def _pivot_distance(pivot):
    return F.bit_count(F.col("fingerprint").bitwiseXOR(F.lit(pivot if pivot < 1 << 63 else pivot - (1 << 64)))).cast("int")


def near_links(fingerprints, radius=2):
    """Links (a, b) that join the distinct fingerprints within `radius` bits of each other to components."""
    spark = fingerprints.sparkSession
    cells = fingerprints.select("fingerprint", _pivot_distance(PIVOTS[0]).alias("x"), _pivot_distance(PIVOTS[1]).alias("y"))
    parts = cells.groupBy("x", "y").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))  # at most 65 * 65 rows
    placed = cells.join(F.broadcast(parts), ["x", "y"]).withColumn("part", F.pmod(F.xxhash64("fingerprint"), "parts").cast("int"))
    shards = written(
        placed.groupBy("x", "y", "part").applyInArrow(_tree_row, "x int, y int, part int, nodes binary, edges binary"), "shards"
    )
    size = shards.agg(F.sum(F.length("nodes") + F.length("edges"))).head()[0] or 0
    passes = max(1, -(-size // (PASS_BYTES // 2)))
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    own = (
        shards.select("x", "y", "part", F.col("nodes").alias("own"), F.explode(steps).alias("dx"))
        .withColumn("dy", F.explode(steps)).where("dx > 0 OR (dx = 0 AND dy >= 0)")
        .select("x", "y", "part", "own", (F.col("x") + F.col("dx")).alias("to_x"), (F.col("y") + F.col("dy")).alias("to_y"))
        .repartition(shuffle_partitions(spark), "x", "y", "part", "to_x", "to_y")
    )
    own = written(own, "searches")
    trees = shards.withColumnsRenamed({"x": "to_x", "y": "to_y", "part": "to_part"})
    links = None
    for turn in range(passes):
        sent = trees.where(F.pmod(F.xxhash64("to_x", "to_y", "to_part"), F.lit(passes)) == turn)
        if passes > 1 and sent.agg(F.sum(F.length("nodes") + F.length("edges"))).head()[0] > PASS_BYTES:
            raise ValueError("the shards of a pass exceed what is sent to the tasks")
        other = (F.col("x") != F.col("to_x")) | (F.col("y") != F.col("to_y"))
        pairs = own.join(F.broadcast(sent), ["to_x", "to_y"]).where(other | (F.col("part") <= F.col("to_part")))
        pairs = pairs.select("own", "nodes", "edges", (~other & (F.col("part") == F.col("to_part"))).alias("same"))
        found = written(pairs.mapInArrow(_forests(radius), "a bigint, b bigint"), "links")
        links = found if links is None else links.unionByName(found)
    return links


def near_duplicates(docs, size=3, radius=2):
    """One row per row of `docs` (doc_id, text): doc_id, fingerprint (16 hexadecimal digits), component_id.

    Fingerprints link at `radius` or fewer differing bits; `component_id` is the smallest doc_id that links lead to. A text
    without words, empty or null has the fingerprint 0, which links like any other. A row that repeats a doc_id is
    judged by its own text. A row with a null doc_id links others but gives no name; if no row of a component
    has one, component_id is null. Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(docs.mapInArrow(_fingerprints(size), "doc_id bigint, fingerprint bigint"), "fingerprints")
    nodes = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(near_links(nodes, radius)).withColumnRenamed("node", "fingerprint")
    rooted = written(nodes.join(roots, "fingerprint", "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(least, "root").select("fingerprint", "component_id"), "named")
    return join_unique(rows, named, ["fingerprint"], spread=["doc_id"], limit=MOST_SENT_IDS).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
