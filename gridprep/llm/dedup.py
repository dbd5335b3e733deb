"""Near-duplicate documents by b-bit MinHash.

Every document becomes the set of its distinct word shingles. Runs of `ROWS` whole minima are hashed
to `BANDS` band keys; of the first `HASHES` minima the low `BITS` bits are kept, packed into 64 bytes.
Documents that share a band key are candidates, the share of equal b-bit fields, corrected for fields that
agree by chance, drops hopeless pairs, and the rest are confirmed on their full sets.

With 48 bands of 6 rows a pair of similarity 0.8 shares no band with probability 5e-7, one of
similarity 0.35 shares a given band with probability 0.002, and the estimate's slack of six standard
deviations loses fewer than 1e-8 of the pairs at the limit.

No group's pairs are listed. Equal sets are one node. In each band group the members are compared with one
chosen at random from the group's largest component, each band choosing anew, for `STARS`
rounds. After the first, members of groups that are still apart are compared with all that share a rare
shingle with them, and leave the groups if their common shingles are too few for any other link; what is left
apart at the end is compared with all members of other components. Of a member's links to centers one is
kept, and its centers are linked with each other, so that there is about one link for each member.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridprep.llm import words as W
from gridprep.llm.components import components
from gridprep.llm.tables import written
from gridprep.operators.joins import broadcast_if_small, join_unique

HASHES, BITS = 128, 4
BANDS, ROWS = 48, 6
MINIMA = BANDS * ROWS
STARS = 2
RARE = 8
MOST_SENT_IDS = 1_000_000  # candidate ids sent to all tasks; more are joined by shuffle
FIELDS = 64 // BITS
SLICE = 1 << 20
LONGEST = 1024

_random = np.random.default_rng(7)
_FACTORS = (_random.integers(1, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_TERMS = _random.integers(0, 1 << 32, MINIMA, dtype=np.uint32)[:, None]
_SEEDS = _random.integers(1, 1 << 63, 2, dtype=np.uint64)


def minima(shingles):
    """The smallest value of each hash function over the (mixed, 64-bit) shingles."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for low in range(0, len(x), LONGEST):
        np.minimum(out, (_FACTORS * x[None, low:low + LONGEST] + _TERMS).min(axis=1), out=out)
    return out


def packed(lows):
    """Low `BITS` bits of the (mixed) minima, `FIELDS` of them in a 64-bit word."""
    fields = (W.mix(lows.astype(np.uint64) + _SEEDS[0]) & np.uint64((1 << BITS) - 1)).reshape(lows.shape[0], -1, FIELDS)
    return np.bitwise_or.reduce(fields << (np.arange(FIELDS, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def band_keys(lows):
    rows = lows.reshape(lows.shape[0], -1, ROWS).astype(np.uint64)
    keys = np.zeros(rows.shape[:2], np.uint64) + np.arange(rows.shape[1], dtype=np.uint64)[None, :]
    for place in range(ROWS):
        keys = W.mix(keys * W.PLACES[place] + rows[:, :, place])
    return keys


def _lists(values):
    """Rows of a two-dimensional array as an Arrow list column."""
    offsets = np.arange(0, values.size + 1, values.shape[1] or 1, dtype=np.int32)[:values.shape[0] + 1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(W.as_signed(np.ascontiguousarray(values)).reshape(-1)))


def shingle_sets(column, size):
    """For each row of a text column, slice by slice: (rows before, the sets of the slice's rows)."""
    data, offsets = W.column_bytes(column)
    for low, high in W.slices(offsets, SLICE):
        hashes, bounds = W.word_hashes(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
        shingles, bounds = W.shingle_hashes(hashes, bounds, size)
        yield low, [W.distinct(shingles[bounds[i]:bounds[i + 1]]) for i in range(high - low)]


def _sketches(size):
    def run(batches):
        for batch in batches:
            for low, sets in shingle_sets(batch.column(1), size):
                lows = np.array([minima(s) for s in sets], np.uint32).reshape(len(sets), MINIMA)
                digest = [[W.mix(s ^ seed).sum(dtype=np.uint64) for s in sets] for seed in _SEEDS]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        *[pa.array(W.as_signed(np.array(d, np.uint64))) for d in digest],
                        _lists(packed(lows[:, :HASHES])), _lists(band_keys(lows)),
                    ],
                    names=["doc_id", "n_shingles", "digest_a", "digest_b", "signature", "bands"],
                )

    return run


def _sets(size):
    def run(batches):
        for batch in batches:
            for low, sets in shingle_sets(batch.column(1), size):
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = W.as_signed(np.concatenate(sets)) if sets else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, len(sets)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=["node", "shingles"],
                )

    return run


def _equal_fields(a, b):
    """How many b-bit fields of two signatures agree."""
    def differing(x):
        any_bit = x
        for step in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, step))
        low_bits = sum(1 << (BITS * i) for i in range(FIELDS))
        return F.bit_count(any_bit.bitwiseAND(F.lit(low_bits if low_bits < 1 << 63 else low_bits - (1 << 64))))

    parts = F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y)))
    return F.lit(HASHES) - F.aggregate(parts, F.lit(0), lambda total, n: total + n)


def estimated_similarity(a, b):
    """Similarity from two signatures, corrected for fields that agree by chance."""
    chance = 1 / (1 << BITS)
    return (_equal_fields(a, b) / F.lit(HASHES) - F.lit(chance)) / F.lit(1 - chance)


def _confirmed(pairs, nodes, sets, percent):
    """The pairs (a, b) that are similar enough: by size, by estimate, then on full sets."""
    slack = 6 * ((percent / 100) * (1 - percent / 100) / HASHES) ** 0.5 / (1 - 1 / (1 << BITS))
    a, b = (nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}")) for c in "ab")
    likely = (
        pairs.join(a, "a").join(b, "b")
        .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .where(estimated_similarity(F.col("s_a"), F.col("s_b")) >= percent / 100 - slack)
        .select("a", "b")
    )
    enough = 100 * F.col("both") >= percent * (F.col("size_a") + F.col("size_b") - F.col("both"))
    return _intersections(likely, sets).where(enough).select("a", "b").distinct()


def _intersections(pairs, sets):
    """The pairs (a, b) with the sizes of their sets and of what they share."""
    a, b = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    found = pairs.join(a, "a").join(b, "b")
    return found.select(
        "a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("both"), F.size("set_a").alias("size_a"), F.size("set_b").alias("size_b")
    )


def _rare(groups, nodes, sets, percent):
    """(pairs, groups): pairs of members that share a rare shingle, and the members that other pairs may hold.

    A shingle is rare if at most `RARE` members have it, so there are few such pairs. Any other pair shares
    common shingles alone: a member with c of them among its n shares at most c with a set of at least the
    group's smallest size, and leaves if that is too little for a link. The others come with n and c.
    """
    members = groups.select("node", "root").distinct()
    owners = sets.join(members, "node").select("node", "root", F.explode("shingles").alias("shingle"))
    rare = owners.groupBy("shingle").agg(F.count("*").alias("owners")).where(F.col("owners") <= RARE)
    held = written(owners.join(rare, "shingle"), "rare")
    lists = held.where("owners > 1").groupBy("shingle").agg(F.sort_array(F.collect_list(F.struct("node", "root"))).alias("m"))
    pairs = lists.select(F.explode(F.flatten(F.transform("m", lambda x, i: F.transform(
        F.filter("m", lambda y: (y["node"] > x["node"]) & (y["root"] != x["root"])), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"))
    )))).alias("p")).select("p.*").distinct()

    sizes = nodes.groupBy("node").agg(F.max("n_shingles").alias("n"), F.min("n_shingles").alias("_least"), F.count("*").alias("texts"))
    counts = held.groupBy("node").agg(F.count("*").alias("rare"))
    common = F.when(F.col("texts") == 1, F.col("n") - F.coalesce("rare", F.lit(0))).otherwise(F.col("n"))
    known = groups.select("band", "node").join(sizes, "node").join(counts, "node", "left").select("band", "node", "n", F.col("_least"), common.alias("common"))
    kept = _with_band(known, known.groupBy("band").agg(F.min("_least").alias("least"))).withColumn("link", ~_too_few(F.col("common"), F.col("n"), F.greatest("common", "least"), percent))
    hopeful = kept.groupBy("node").agg(F.bool_or("link").alias("link")).where("link").select("node")
    return pairs, known.select("band", "node", "n", "common").join(hopeful, "node", "left_semi")


def _too_few(shared, n_x, n_y, percent):
    """Whether sets of these sizes with at most `shared` shingles in common cannot be linked."""
    return 100 * shared < percent * (n_x + n_y - shared)


def _apart(groups, roots, seed):
    """The members of groups that are not one component yet: band, node, root, largest component."""
    if roots is None:
        labelled = groups.withColumn("root", F.col("node"))
    else:
        labelled = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = labelled.groupBy("band", "root").agg(F.count("*").alias("n"))
    order = F.struct("n", F.xxhash64(F.lit(seed), "band", "root"), "root")
    largest = parts.groupBy("band").agg(F.max_by("root", order).alias("largest"), F.count("*").alias("parts")).where("parts > 1")
    return _with_band(labelled, largest.drop("parts"))


def _with_band(members, bands):
    """Members with their band's row of a table; the members of a hot band are not brought together."""
    return join_unique(members, written(bands, "bands"), ["band"], spread=["node"], limit=MOST_SENT_IDS)


def _contracted(links):
    """Links (a: member, b: center) with the same components: each member's first center, and that center's with the member's others."""
    stars = links.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("centers"))  # at most one center for each band
    first = F.get("centers", F.lit(0))
    between = stars.select(first.alias("a"), F.explode(F.slice("centers", 2, BANDS)).alias("b")).distinct()
    return stars.select("a", first.alias("b")).unionByName(between)


def _possible(apart, nodes, sets, percent):
    """The pairs of members of open groups, of different components, that may still be linked.

    They share no rare shingle. Seen from a group's center, the member with the most common shingles, two
    members share at most the smaller of what each shares with it and the smaller of the common shingles each has
    beside it.
    """
    apart = written(apart, "apart")
    center = apart.groupBy("band").agg(F.max_by(F.struct("node", (F.col("n") - F.col("common")).alias("rare")), F.struct("common", "node")).alias("c"))
    centered = written(_with_band(apart, center).select("*", F.col("c.node").alias("center"), F.col("c.rare").alias("_rare")).drop("c"), "centered")
    shared = _intersections(centered.select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), sets)
    shared = shared.groupBy("a", "b").agg(F.max("both").alias("inner"), F.min("both").alias("_least")).withColumnsRenamed({"a": "center", "b": "node"})
    placed = written(
        centered.join(shared, ["center", "node"]).join(nodes.select("node", "bands"), "node")
        .select("band", "bands", "node", "root", "largest", "n", "common", "inner", (F.col("common") - F.col("_least") + F.col("_rare")).alias("outer")), "placed",
    )
    columns = ["node", "root", "n", "common", "inner", "outer", "bands"]
    one, other = (part.select("band", *[F.col(c).alias(f"{c}_{x}") for c in columns]) for x, part in (("x", placed.where("root <> largest")), ("y", placed)))
    most = F.least(F.least("common_x", "common_y"), F.least("inner_x", "inner_y") + F.least("outer_x", "outer_y"))
    return (
        one.join(other, "band")
        .where("root_x <> root_y")
        .where(~_too_few(most, F.col("n_x"), F.col("n_y"), percent))
        .where(F.get(F.array_intersect("bands_x", "bands_y"), F.lit(0)) == F.col("band"))  # in the first group they share
        .select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))
        .distinct()
    )


def near_duplicates(docs, size=5, percent=80):
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of `size`-word
    shingles. `component_id` is the smallest doc_id that links lead to, `kept` marks it.
    Empty and null texts have no shingles and are linked with nothing. A row that repeats a doc_id is
    judged by its own text; texts of which that doc_id is the smallest count as linked. A null
    doc_id is linked with nothing, has a null component and is kept. Other columns are
    ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = written(
        docs.mapInArrow(
            _sketches(size),
            "doc_id bigint, n_shingles bigint, digest_a bigint, digest_b bigint, signature array<bigint>, bands array<bigint>",
        ),
        "sketches",
    )
    digest = ["digest_a", "digest_b", "n_shingles"]
    real = sketches.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    nodes = written(
        real.groupBy(*digest).agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("bands").alias("bands")),
        "nodes",
    )
    rows = nodes.select("node", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("node").alias("_first"), F.max("node").alias("_last")).where("_first < _last")
    groups = written(_with_band(rows, shared.select("band")), "groups")

    ids = broadcast_if_small(written(groups.select(F.col("node").alias("doc_id")).distinct(), "ids"), MOST_SENT_IDS)
    sets = written(docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets(size), "node bigint, shingles array<bigint>"), "sets")

    links, roots = None, None
    for seed in range(STARS):
        apart = written(_apart(groups, roots, seed), "apart")
        # once known, members with the most common shingles: they are the least changed
        rank = F.struct(*(["common"] if seed else []), F.xxhash64(F.lit(seed), "band", "node"), "node")
        center = apart.where("root = largest").groupBy("band").agg(F.max_by("node", rank).alias("center"))
        star = _with_band(apart.where("root <> largest"), center).select(F.col("node").alias("a"), F.col("center").alias("b"))
        more = written(_contracted(_confirmed(star.distinct(), nodes, sets, percent)), "links")
        links = more if links is None else links.unionByName(more)
        roots = components(links)
        if seed == 0:
            open_groups = written(_apart(groups, roots, seed).select("band", "node", "root"), "open")
            pairs, groups = _rare(open_groups, nodes, sets, percent)
            # the next round's components take these links in
            links = links.unionByName(written(_confirmed(pairs, nodes, sets, percent), "links"))
            groups = written(groups, "groups")
    rest = _possible(_apart(groups, roots, STARS), nodes, sets, percent)
    more = written(_confirmed(rest, nodes, sets, percent), "links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    of_digest = nodes.join(roots, "node", "left").select(*digest, F.coalesce("root", "node").alias("_root"))
    linked = real.select("doc_id", *digest).join(of_digest, digest, "left")
    alone = sketches.where((F.col("n_shingles") <= 0) | F.col("doc_id").isNull()).select("doc_id", *digest, F.col("doc_id").alias("_root"))
    return linked.unionByName(alone).select(
        "doc_id", "n_shingles", F.col("_root").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("_root"), F.lit(True)).alias("kept"),
    )
