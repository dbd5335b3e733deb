"""Packed arrays come back as they were, and batches of long arrays lie small on the disk."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import gridprep.operators.batches as module
from gridprep.operators.batches import collate
from gridprep.operators.packed import PACKED, Packed, pack_arrays, stored_packed

SCHEMA = "k int, b array<tinyint>, s array<smallint>, i array<int>, l array<bigint>, t array<string>, x string, f array<double>"
ROWS = [
    (1, [1, -128, 127], [300], [2**31 - 1, -(2**31)], [2**63 - 1, -(2**63)], ["a", None], "x", [0.5]),
    (2, [], None, [None, 1, None], [None], None, None, None),
    (3, None, [], None, [], [], "", []),
    (4, [None], [None, 32767, -32768], [], None, ["b"], "z", [None]),
    (None, None, None, None, None, None, None, None),
]


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_arrays_come_back(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    packed = pack_arrays(df)
    assert packed.columns == ["k", "t", "x", "f", PACKED]
    for back in (Packed(packed, df.schema).unpacked(), stored_packed(df).unpacked()):
        assert back.schema == df.schema and plain(back.collect()) == plain(ROWS)
    assert pack_arrays(df.select("k", "x")).columns == ["k", "x"]
    assert pack_arrays(df, leave=["l"]).columns == ["k", "l", "t", "x", "f", PACKED]
    empty = df.where("false")
    assert Packed(pack_arrays(empty), df.schema).unpacked().collect() == []


def test_long_rows_come_back_in_small_batches(spark):
    df = spark.range(40, numPartitions=1).select("id", F.sequence(F.lit(0), F.lit(100_000)).alias("ids"), (F.col("id") % 3).alias("g"))
    back = Packed(pack_arrays(df), df.schema).unpacked()
    assert back.agg(F.sum(F.size("ids"))).head()[0] == 40 * 100_001
    assert back.where(F.col("ids") != F.sequence(F.lit(0), F.lit(100_000))).count() == 0


def folder_bytes(spark):
    root = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    return sum(p.stat().st_size for p in root.rglob("*") if p.is_file())


def test_batches_of_long_arrays_lie_small(spark):
    """What collate keeps is a fraction of the numbers: labels repeat the ids, and positions follow a pattern."""
    n, length = 600, 4096
    chance = random.Random(5)
    rows = [(chance.random(), [chance.randrange(60) for _ in range(length)]) for _ in range(n)]
    df = spark.createDataFrame(rows, "name double, input_ids array<int>").select(
        "name", "input_ids", F.transform("input_ids", lambda x: F.lit(1).cast("tinyint")).alias("attention_mask"), F.col("input_ids").alias("labels"),
        F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda x: (x / 64).cast("int")).alias("row_ids"), F.lit(0).alias("identity_idx"),
    ).checkpoint()
    fields = [(c, c, None) for c in ("input_ids", "labels", "attention_mask", "identity_idx", "row_ids")]
    before = folder_bytes(spark)
    batches = collate(df, ["name"], 16, fields)
    assert folder_bytes(spark) - before < n * length * 2
    found = [(ids, labels) for r in sorted(batches.collect(), key=lambda r: r.batch) for ids, labels in zip(r.input_ids, r.labels)]
    assert found == [(ids, ids) for _, ids in sorted(rows)]


@pytest.mark.parametrize("per_range", [7, 4096])
def test_packed_rows_give_the_same_batches(spark, monkeypatch, per_range):
    """Batches lie in one range or span several. Labels are made behind the sort then, also where arrays are null, have gaps or differ in length."""
    monkeypatch.setattr(module, "ROWS_PER_RANGE", per_range)
    kinds = "name int, input_ids array<int>, attention_mask array<tinyint>, labels array<int>, extra string"
    odd = [([1, 2, None], [1, 0, None]), (None, [1]), ([5, 6], None), ([7, 8], [0]), ([9], [1, 0, 0]), ([], []), ([3, 4], [0, 1])]
    fields = [(c, c, None) for c in ("input_ids", "labels", "attention_mask")]
    for rows in (odd * 9, [odd[0], odd[6]] * 30):
        df = spark.createDataFrame([(i, ids, mask, ids, "x") for i, (ids, mask) in enumerate(rows)], kinds).repartition(5)
        plain_rows, packed_rows = (sorted(map(tuple, collate(t, ["name"], 4, fields).collect())) for t in (df, stored_packed(df)))
        assert plain_rows == packed_rows and len(plain_rows) == -(-len(rows) // 4)
        assert plain_rows[0][3][0] == [1, -100, None]
        assert [ids for r in plain_rows for ids in r[2]] == [ids for ids, _ in rows]


def test_batches_of_null_and_equal_keys_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(module, "ROWS_PER_RANGE", 10)
    rows = [(None if i % 9 == 0 else i % 23, i, [i, None]) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, a int, l array<int>")
    found = sorted(map(tuple, collate(df, ["k"], 16, [("k", "k", None), ("a", "a", None), ("l", "l", None)]).collect()))
    assert [(r[0], r[1]) for r in found] == [(i, 16 if i < 31 else 4) for i in range(32)]
    keys = [k for r in found for k in r[2]]
    assert keys == sorted((k for k, _, _ in rows), key=lambda k: (k is not None, k or 0))
    assert sorted(a for r in found for a in r[3]) == list(range(500))
    assert all(pair == [a, None] for r in found for a, pair in zip(r[3], r[4]))
