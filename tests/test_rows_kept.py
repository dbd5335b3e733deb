"""Nulls, repeated keys and odd files: no row vanishes, multiplies or gets another row's values."""

import pytest
from pyspark.sql import functions as F

from gridprep.operators import joins
from gridprep.operators.batches import collate
from gridprep.operators.joins import spread_join
from gridprep.operators.keys import index_keys
from gridprep.operators.metadata import chain_stage, shape_species
from gridprep.operators.scoring import weighted_nll
from gridprep.operators.selection import blend_vectors, make_negatives, sample_fields
from gridprep.operators import vocab as vocabularies
from gridprep.operators.vocab import decode_ids, encode_ids
from gridprep.sources.logs import scan_log, scrape_log
from gridprep.sources.metadata import read_metadata

END = "=" * 36


@pytest.mark.parametrize("limit", [100, 0])
def test_lookups_of_equal_null_and_repeated_keys(spark, limit):
    texts = spark.createDataFrame([(1, ["a", "b"]), (1, ["c"]), (None, ["a"]), (2, []), (2, None), (2, ["x", "a", "a"])], "k int, tokens array<string>")
    vocab = spark.createDataFrame([("a", 10), ("b", 11), ("c", 12), ("a", 13), ("[UNK]", 3)], "token string, id int")
    rows = encode_ids(texts, vocab, limit=limit).collect()
    assert sorted(r.input_ids for r in rows if r.tokens) == [[3, 10, 10], [10], [10, 11], [12]]
    assert all((r.tokens or []) and True or r.input_ids == [] for r in rows) and len(rows) == 6
    back = decode_ids(spark.createDataFrame([(1, [10, 12]), (1, [99]), (None, [11])], "k int, input_ids array<int>"), vocab, limit=limit)
    assert sorted(str(r.tokens) for r in back.collect()) == ["['a', 'c']", "['b']", "[None]"]


def test_dictionaries_of_many_parts(spark):
    """Parts of three elements, frequent tokens spread, and parts whose dictionary is empty."""
    texts = spark.createDataFrame([(i, f"a  b{i % 7} zz") for i in range(200)] + [(200, "zz zz"), (201, None), (202, " ")], "k int, tokens string")
    vocab = spark.createDataFrame([("a", 1)] + [(f"b{i}", 10 + i) for i in range(7)], "token string, id int")
    found = vocabularies._lookup_by_join(texts.repartition(4), vocab, "tokens", "ids", 3, spread_from=20, part_elements=3)
    want = {i: [1, 10 + i % 7, 3] for i in range(200)} | {200: [3, 3], 201: [], 202: []}
    assert {r.k: r.ids for r in found.collect()} == want and found.count() == 203
    none = vocabularies._lookup_by_join(texts, vocab.where("false"), "tokens", "ids", 3)
    assert {r.k: r.ids for r in none.collect()} == {k: [3] * len(v) for k, v in want.items()}
    assert vocabularies._lookup_by_join(texts.where("false"), vocab, "tokens", "ids", 3).count() == 0


def log_file(folder, text):
    path = folder / "log.txt"
    path.write_bytes(text.encode())
    return str(path)


def samples(spark, path):
    return sorted((r.step, r["sample"]) for r in scrape_log(scan_log(spark, path)).collect())


@pytest.mark.parametrize("text, expected", [
    (f"=== Inference @ step 5 ===\na {END}=\nb\n{END}\n=== Inference @ step 6 ===\nc\n{END}\n", [(5, f"a {END}=\nb"), (6, "c")]),
    (f"x\r\n=== Inference @ step 5 ===\r\na\r\nb\r\n{END}\r\n=== Inference @ step 6 ===\r\nc\r\n{END}\r\n", [(5, "a\nb"), (6, "c")]),
    (f"=== Inference @ step 5 ===\n{END}\na\n{END}\n=== Inference @ step 6 ===\nc\n{END}", [(5, f"{END}\na"), (6, "c")]),
    (f"=== Inference @ step 5 ===\na\n{END}==\n=== Inference @ step 6 ===\nno end", [(5, "a")]),
])
def test_logs(spark, tmp_path, text, expected):
    assert samples(spark, log_file(tmp_path, text)) == expected


def test_batches_of_null_and_equal_keys(spark):
    rows = [(None if i == 3 else i // 2, i) for i in range(10)]
    df = spark.createDataFrame([(k, [i], [i], [i % 2], i) for k, i in rows], "k int, input_ids array<int>, labels array<int>, attention_mask array<int>, color_idx int")
    found = collate(df, ["k"], batch_size=4).orderBy("batch").collect()
    assert [r.n for r in found] == [4, 4, 2]
    assert sorted(i for r in found for ids in r.input_ids for i in ids) == list(range(10))
    assert found[0].input_ids[0] == [3] and sorted(i for r in found for i in r.color_idx) == list(range(10))
    for r in found:
        assert all(label == ([i] if i % 2 else [-100]) for label, (i,) in zip(r.labels, r.input_ids))


def test_null_keys_and_names(spark):
    images = spark.createDataFrame([(None, 1, 1, 3, bytearray(b"abc")), (2, 1, 1, 3, bytearray(b"abc"))], "k int, height int, width int, n_channels int, data binary")
    assert make_negatives(images, ["k"]).groupBy("label").count().orderBy("label").collect() == [(0, 2), (1, 2)]
    names = spark.createDataFrame([("b.txt",), (None,), ("a.txt",)], "name string")
    assert sorted(((r.name, r.identity_idx) for r in index_keys(names).collect()), key=str) == [("a.txt", 0), ("b.txt", 1), (None, None)]


def test_a_missing_vector_makes_the_blend_null(spark):
    picks = spark.createDataFrame([(1, 0, 5, 0.0), (1, 1, 6, 0.0), (2, 0, 5, 0.0), (2, 1, 99, 0.0), (3, 0, 98, 0.0)], "k int, pick int, vec_id long, logit double")
    vectors = spark.createDataFrame([(5, [1.0, 2.0]), (6, [3.0, 4.0])], "vec_id long, vector array<double>")
    assert {r.k: r.vector for r in blend_vectors(picks, vectors, ["k"]).collect()} == {1: [2.0, 3.0], 2: None, 3: None}


def test_cut_off_json_is_an_error(spark, tmp_path):
    path = tmp_path / "species.json"
    path.write_text('[{"id": 1, "name": "a"}, {"id": 2, "na')
    with pytest.raises(Exception, match="JSON|Malformed|MALFORMED"):
        read_metadata(spark, str(path)).collect()
    path.write_text('[{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]')
    assert read_metadata(spark, str(path)).count() == 2
    with pytest.raises(Exception, match="JSON|Malformed|MALFORMED"):
        shape_species(spark.createDataFrame([('{"id": 1, "na',)], "json string")).collect()


def test_two_parents_are_an_error(spark):
    edges = spark.createDataFrame([(None, "a"), (None, "b"), ("a", "c"), ("a", "c"), ("b", "c")], "parent string, child string")
    targets = spark.createDataFrame([("c",)], "target string")
    with pytest.raises(ValueError):
        chain_stage(edges, targets)
    assert chain_stage(edges.where("parent IS NULL OR parent = 'a'"), targets).collect() == [("c", 2, False)]


def test_an_undefined_loss_is_nothing(spark):
    df = spark.createDataFrame([([1, 2], [float("nan"), 0.0])], "labels array<int>, nll array<double>")
    weights = spark.createDataFrame([(2, 1.0)], "id int, weight double")
    assert weighted_nll(df, weights).head().loss == 0.0


def test_identities_are_given_or_drawn(spark):
    df = spark.createDataFrame([(1, None), (2, 7)], "k int, identity_idx int")
    found = {r.k: r.identity_idx for r in sample_fields(df, ["k"], n_identities=3).collect()}
    assert found[2] == 7 and 0 <= found[1] < 3
    assert "identity_idx" not in sample_fields(df.drop("identity_idx"), ["k"]).columns


def test_hot_keys_are_spread(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    table = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "k long, v string")
    found = spread_join(df, table, "k", "left", rows_per_task=50)
    assert sorted(map(str, found.collect())) == sorted(map(str, df.join(table, "k", "left").select(found.columns).collect()))


def test_batches_across_ranges(spark):
    """Every batch size, with ranges that hold less than a batch, against the sorted rows."""
    rows = [(i * 7919 % 500, None if i % 11 == 3 else i, [i, i + 1]) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int, a array<int>")
    ordered = sorted(rows)
    for size in (1, 3, 16, 100, 1000):
        found = {b["batch"]: b for b in collate(df, ["k"], size, [("v", "v", "v"), ("a", "a", None), ("w", "a", "v"), ("x", "no", None)]).collect()}
        assert sorted(found) == list(range(-(-500 // size)))
        for number, batch in found.items():
            part = ordered[number * size:(number + 1) * size]
            known = all(r[1] is not None for r in part)
            assert batch["n"] == len(part) and batch["a"] == [r[2] for r in part] and batch["x"] is None
            assert batch["v"] == ([r[1] for r in part] if known else None) and batch["w"] == ([r[2] for r in part] if known else None)


def test_only_frequent_keys_are_copied(spark):
    df = spark.createDataFrame([(1 if i % 3 == 0 else i,) for i in range(300)], "k int")
    table = spark.createDataFrame([(i, i) for i in range(300)], "k int, v int")
    hot = {r["k"]: r["_parts"] for r in joins._hot_keys(df, ["k"], 50).collect()}
    assert hot == {1: 3}
    assert joins._hot_keys(df, ["k"], 1000) is None
    few = {r["k"] for r in joins._hot_keys(df, ["k"], 0, most=3).collect()}
    assert few == {1}
    found = joins.join_unique(df, table, ["k"], limit=10, rows_per_task=50)
    assert sorted(r["v"] for r in found.collect()) == sorted(r["k"] for r in df.collect())
