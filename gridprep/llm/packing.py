"""Packing of documents into sequences by minimum bin slack.

What has to be packed is fully described by how many pieces there are of each length: at most `capacity`
numbers, counted over all documents. The driver packs those: for each bin it takes the longest
remaining length and finds the fullest feasible combination with it by subset-sum dynamic programming over
the remaining lengths, the reachable sums being the bits of one integer; the combination is
removed as often as the counts allow. Pieces find their place in the plan by their rank among
the pieces of their length, which is a running number inside the task that made them plus the numbers
of the tasks before.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window, functions as F

from gridprep.llm.tables import written
from gridprep.llm.tokens import default_paths, token_ids

CAPACITY = 1024
END = 2
_RANKS = 1 << 44  # more pieces of one length than this cannot be told apart


def fullest(longest, counts, capacity):
    """The combination {length: times} with the largest sum up to `capacity` that holds `longest`."""
    reach, steps, goal = 1 << longest, [], 1 << capacity
    mask = (goal << 1) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), (capacity - longest) // length)
        part = 1
        while left > 0 and not reach & goal:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            left -= part
            part *= 2
        if reach & goal:
            break
    target = reach.bit_length() - 1
    chosen = {longest: 1}
    for length, part, before in reversed(steps):
        if not before >> target & 1:
            chosen[length] = chosen.get(length, 0) + part
            target -= length * part
    return chosen


def plan(counts, capacity=CAPACITY):
    """Bins as (first sequence, repeats, {length: times}), from {length: count}."""
    counts = {length: n for length, n in counts.items() if n > 0}
    bins, sequence = [], 0
    while counts:
        chosen = fullest(max(counts), counts, capacity)
        repeats = min(counts[length] // times for length, times in chosen.items())
        bins.append((sequence, repeats, chosen))
        sequence += repeats
        for length, times in chosen.items():
            counts[length] -= times * repeats
            if not counts[length]:
                del counts[length]
    return bins


def _places(bins):
    """The plan by piece: arrays of key (length and first rank), first rank, first sequence, times, offset."""
    used, rows = {}, []
    for sequence, repeats, chosen in bins:
        offset = 0
        for length, times in sorted(chosen.items(), reverse=True):
            first = used.get(length, 0)
            rows.append((length * _RANKS + first, first, sequence, times, offset))
            used[length] = first + repeats * times
            offset += length * times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _pieces(capacity, paths):
    def run(batches):
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out = []
            for row, text in enumerate(batch.column(1)):
                ids = np.append(token_ids(text.as_py() or "", paths), np.uint32(END)).astype("<u4")
                first = len(ids) % capacity or min(len(ids), capacity)
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    out.append((row, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), seen[b - a]))
                    seen[b - a] += 1
            table = np.array(out, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32)),
                    *[pa.array(table[:, i]) for i in range(2, 6)], pa.array(np.full(len(table), task, np.int32)),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "rank", "task"],
            )

    return run


def _place(places):
    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = places[np.searchsorted(places[:, 0], length * _RANKS + rank, "right") - 1]
            inside = rank - row[:, 1]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(row[:, 2] + inside // row[:, 3]), pa.array(row[:, 4] + inside % row[:, 3] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs, capacity=CAPACITY, paths=None):
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document (doc_id, text) is the ids of its text and then id 2; a null or empty text is that one id. Longer
    ones than `capacity` are cut so that only the first piece may be shorter. Every row is packed, also one
    that repeats another or has a null doc_id. `ids_crc32` is of the piece's ids as little-endian 32-bit
    numbers. Other columns are ignored; an empty table gives an empty result. `paths` are the files of the
    vocabulary (tokenizer, ranks).
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(
        rows.mapInArrow(
            _pieces(capacity, paths or default_paths()),
            "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, rank bigint, task int",
        ),
        "pieces",
    )
    made = written(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    starts = made.select("task", "length", before.alias("before"))
    totals = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranked = pieces.join(starts, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _place(_places(plan(totals, capacity))),
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )
