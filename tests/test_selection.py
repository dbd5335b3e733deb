"""Ranking, sampling and selection against plain Python, with hot groups."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridprep.constants import SPECIAL_TOKENS
from gridprep.operators.batches import collate
from gridprep.operators.joins import join_unique
from gridprep.operators.keys import attach_by_name, index_keys
from gridprep.operators.metadata import chain_stage
from gridprep.operators.ranking import global_rank
from gridprep.operators.scoring import binary_eval, filter_candidates, token_share, weighted_nll
from gridprep.operators.selection import (
    allowed_tokens, best_of_n, blend_vectors, class_tokens, make_negatives, mask_allows, mask_ids, resolve_conditioning, sample_fields, sample_picks,
    split_rows, sum_vectors, with_token_class, with_token_mask,
)
from gridprep.sources.tables import last_per_key


@pytest.mark.parametrize("n, parts", [(0, None), (1, None), (7, 3), (500, 8), (3000, 40)])
def test_global_rank(spark, n, parts):
    # a third of the rows share the first column
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", i) for i in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "a STRING, b INT").repartition(5)
    ranked = global_rank(df, ["a", "b"], parts=parts)
    assert [(r["a"], r["b"]) for r in sorted(ranked.collect(), key=lambda r: r["rank"])] == sorted(rows)
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(n))


def test_rank_parts_are_balanced_despite_a_hot_value(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("a"), F.col("id").alias("b"))
    ranked = global_rank(df, ["a", "b"], parts=8)
    from gridprep.operators.ranking import _part_of, _split_points
    points = _split_points(df, ["a", "b"], 8)
    sizes = [r["count"] for r in df.groupBy(_part_of(F.struct("a", "b"), points).alias("p")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2.5 * 20_000 / 8
    assert ranked.count() == 20_000


def test_index_keys_beyond_the_broadcast_limit(spark, monkeypatch):
    names = [f"{i % 40:03d}{'_flip' if i % 2 else ''}.txt" if i % 3 else "000.txt" for i in range(600)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i INT, name STRING")
    keys = sorted({n.replace("_flip", "").replace(".txt", "") for n in names})
    expected = {i: keys.index(n.replace("_flip", "").replace(".txt", "")) for i, n in enumerate(names)}
    assert {r["i"]: r["identity_idx"] for r in index_keys(df).collect()} == expected
    monkeypatch.setattr("gridprep.operators.joins.is_small", lambda *_: False)
    assert {r["i"]: r["identity_idx"] for r in index_keys(df).collect()} == expected


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_broadcast(spark, monkeypatch, how):
    rows = [("hot" if i % 3 == 0 else f"k{i % 20}" if i % 3 == 1 else None, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k STRING, i INT")
    table = spark.createDataFrame([(f"k{i}", i) for i in range(10)] + [("hot", -1)], "k STRING, v INT")
    small = sorted(map(str, join_unique(df, table, ["k"], how).collect()))
    large = join_unique(df, table, ["k"], how, limit=3)
    assert sorted(map(str, large.collect())) == small
    monkeypatch.setattr("gridprep.operators.joins.is_small", lambda *_: False)
    assert sorted(map(str, join_unique(df, table, ["k"], how).collect())) == small


def test_last_duplicate_wins(spark):
    rows = [("hot", i) if i % 2 else (f"n{i % 5}", i) for i in range(100)]
    df = spark.createDataFrame(rows, "name STRING, v INT")
    expected = dict(sorted(rows, key=lambda r: r[1]))
    assert {r["name"]: r["v"] for r in last_per_key(df, ["name"], ["v"]).collect()} == expected
    attributes = df.select("name", F.col("v").alias("position"), (F.col("v") * 10).alias("w"))
    found = attach_by_name(df, attributes, ["position"]).collect()
    assert len(found) == 100 and all(r["w"] == expected[r["name"]] * 10 for r in found)


def test_collate(spark):
    rows = [(i, i * 2, None if i == 5 else i) for i in range(10)]
    df = spark.createDataFrame(rows, "k INT, a INT, b INT").repartition(4)
    batches = collate(df, ["k"], 4, [("x", "a", None), ("y", "b", "b"), ("z", "c", "c")]).orderBy("batch").collect()
    assert [(b["n"], b["x"], b["y"], b["z"]) for b in batches] == [
        (4, [0, 2, 4, 6], [0, 1, 2, 3], None), (4, [8, 10, 12, 14], None, None), (2, [16, 18], [8, 9], None)]


def test_best_of_n(spark):
    rows = [("a", 0, 0.1), ("a", 1, 0.6), ("a", 2, 0.9), ("b", 0, 0.1), ("b", 1, 0.3), ("b", 2, 0.3), ("b", 3, 0.99), ("c", 5, 0.2)]
    rows += [("hot", i, 0.001 * (i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "g STRING, i INT, score DOUBLE").repartition(4)
    found = {r["g"]: r["i"] for r in best_of_n(df, ["g"], ["i"]).collect()}
    assert found == {"a": 1, "b": 1, "c": 5, "hot": 2}


def test_groups_are_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").alias("i"), F.rand(1).alias("score"))
    plan = best_of_n(df, ["g"], ["i"])._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan.split("WindowGroupLimit")[-1]
    plan = last_per_key(df, ["g"], ["i"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("n, frac, expected", [(1, 0.1, 1), (5, 0.1, 1), (19, 0.1, 1), (1000, 0.1, 100), (1000, 0.333, 333), (40, 1.0, 40)])
def test_split_takes_an_exact_number(spark, n, frac, expected):
    split = split_rows(spark.range(n), ["id"], frac, seed=3)
    assert split.where("is_validation").count() == expected and split.count() == n
    other = split_rows(spark.range(n), ["id"], frac, seed=4)
    if n == 1000:
        assert split.where("is_validation").exceptAll(other.where("is_validation")).count() > 0


def test_sampling_stays_in_range_and_repeats(spark):
    df = spark.range(400).select("id", F.when(F.col("id") < 10, 7).cast("int").alias("type1"))
    one, again = (sample_fields(df, ["id"], 5).orderBy("id").collect() for _ in range(2))
    assert one == again and [r["type1"] for r in one[:10]] == [7] * 10
    assert {r["type2"] for r in one} == set(range(20)) and {r["color_shift"] for r in one} == set(range(6))
    explicit = spark.range(300).select("id", F.when(F.col("id") == 0, 9).cast("int").alias("generation"))
    resolved = resolve_conditioning(explicit, ["id"]).orderBy("id").collect()
    assert resolved[0]["generation"] == 9 and {r["generation"] for r in resolved[1:]} == {2, 3}
    assert {(r["color_shift"], r["is_shiny"]) for r in resolved} == {(0, 0)}


def test_blend_and_sum(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], "id INT, vector ARRAY<DOUBLE>")
    picks = spark.createDataFrame([("t", 0, 0, 0.0), ("t", 1, 1, math.log(3)), ("u", 0, 1, 5.0)], "t STRING, pick INT, vec_id INT, logit DOUBLE")
    blended = {r["t"]: r["vector"] for r in blend_vectors(picks, vectors.withColumnRenamed("id", "vec_id"), ["t"], "vec_id", "vector").collect()}
    assert blended["t"] == pytest.approx([0.25, 1.5]) and blended["u"] == pytest.approx([0.0, 2.0])
    rows = spark.createDataFrame([("r", 0, 1), ("s", 1, 9)], "k STRING, a INT, b INT")
    total = {r["k"]: r["vector"] for r in sum_vectors(rows, [("a", vectors), ("b", vectors)]).collect()}
    assert total == {"r": [1.0, 2.0], "s": None}
    wide = sum_vectors(rows, [("a", vectors), ("b", vectors)], most_bytes=10)
    assert {r["k"]: r["vector"] for r in wide.collect()} == total
    drawn = sample_picks(spark.range(500), ["id"], 7, 3, 1)
    assert drawn.count() == 1500 and {r["vec_id"] for r in drawn.collect()} == set(range(7))
    assert abs(drawn.agg(F.avg("logit")).first()[0]) < 0.1


def test_candidates(spark):
    chance = random.Random(2)
    steps = [[(f"t{i}", chance.choice([0.0, 1.0, 2.5, chance.random() * 4])) for i in range(chance.randint(1, 30))] for _ in range(40)] + [[]]
    df = spark.createDataFrame(list(enumerate(steps)), "s INT, scores ARRAY<STRUCT<token: STRING, logit: DOUBLE>>")

    def expected(step, k, p, t):
        ranked = sorted(step, key=lambda c: (-c[1], c[0]))[: k or None]
        mass = [math.exp(c[1] / t) for c in ranked]
        kept, total = [], 0.0
        for c, m in zip(ranked, mass):
            if total < p - 1e-9:
                kept.append(c[0])
            total += m / sum(mass)
        return kept

    for k, p, t in ((0, 1.0, 1.0), (5, 1.0, 0.7), (0, 0.8, 1.0), (10, 0.5, 2.0)):
        found = {}
        for r in filter_candidates(df, k=k, p=p, temperature=t).orderBy("s", "rank").collect():
            found.setdefault(r["s"], []).append(r["token"])
        assert found == {i: expected(step, k, p, t) for i, step in enumerate(steps) if step}


def test_allowed_tokens(spark):
    tokens = SPECIAL_TOKENS + ["a", "ab", "abc", "~", "[", "]"]
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token STRING, id INT")
    states = [(row, used) for row in (-1, 0, 5, 63) for used in range(6)]
    df = spark.createDataFrame(states, "row INT, used INT")

    def expected(row, used, width=4):
        if row < 0:
            return set(tokens)
        if used >= width:
            return {f"[ROW_{row + 1:02d}]"} if row < 63 else {"[EOS]"}
        return {t for t in tokens if not (t[0] == "[" and t[-1] == "]") and len(t) <= width - used}

    for r in allowed_tokens(df, vocab, width=4).collect():
        assert {tokens[i] for i in r["allowed"]} == expected(r["row"], r["used"])
    by_class = with_token_class(df, width=4).join(class_tokens(vocab, 4), "token_class").collect()
    assert {(r["row"], r["used"], tokens[r["id"]]) for r in by_class} == {(*s, t) for s in states for t in expected(*s)}
    # ids with gaps, and masks sent to the tasks or joined by shuffle
    apart = vocab.withColumn("id", F.col("id") * 37 + 5)
    probes = F.sequence(F.lit(0), F.lit(37 * len(tokens) + 300))
    for most_bytes in (1 << 20, 0):
        masked = with_token_mask(df, apart, width=4, most_bytes=most_bytes)
        asked = masked.select("row", "used", mask_ids(F.col("mask")).alias("ids"), F.filter(probes, lambda i: mask_allows(F.col("mask"), i)).alias("asked"))
        for r in asked.collect():
            assert r["ids"] == r["asked"] and {tokens[(i - 5) // 37] for i in r["ids"]} == expected(r["row"], r["used"])
            assert all(i % 37 == 5 for i in r["ids"])
    assert allowed_tokens(df, vocab.where("false"), width=4).where(F.size("allowed") == 0).count() == len(states)


def test_losses(spark):
    df = spark.createDataFrame([("a", [9, 1, 2, -100, 1], [0.5, 1.0, 7.0, 2.0, 99.0], 4.0), ("b", [3], [1.0], 4.0), ("c", [1, -100], [1.0, 1.0], 4.0)],
                               "g STRING, labels ARRAY<INT>, nll ARRAY<DOUBLE>, n DOUBLE")
    weights = spark.createDataFrame([(1, 0.6)], "id INT, weight DOUBLE")
    mean = {r["g"]: r["loss"] for r in weighted_nll(df, weights, ["g"]).collect()}
    assert mean == {"a": pytest.approx((0.6 * 0.5 + 1.0 + 0.6 * 2.0) / 2.2), "b": 0.0, "c": 0.0}
    counted = {r["g"]: r["loss"] for r in weighted_nll(df, weights, ["g"], count="n").collect()}
    assert counted["a"] == pytest.approx((0.6 * 0.5 + 1.0 + 0.6 * 2.0) / 4)
    empty = spark.createDataFrame([], "probability DOUBLE, label INT")
    assert tuple(binary_eval(empty).first()) == (0.0, 0.0)
    rows = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.0, 1), (0.2, 0)], "probability DOUBLE, label INT")
    found = binary_eval(rows).first()
    assert found["accuracy"] == 0.5
    assert found["loss"] == pytest.approx((-math.log(0.9) - math.log(0.5) + 100 - math.log(0.8)) / 4)


def test_token_share(spark):
    df = spark.createDataFrame([(t,) for t in "aaab"], "token STRING")
    assert {r["token"]: r["share"] for r in token_share(df).collect()} == {"a": 0.75, "b": 0.25}


def test_negatives(spark):
    # images of one strategy each: rows shuffled, noise, half replaced
    size = 16
    pixel = [(y, x, y * 10, x * 10, 7) for y in range(size) for x in range(size)]
    data = bytes(v for y, x, r, g, b in pixel for v in (b, g, r))
    df = spark.createDataFrame([(k, size, size, 3, data) for k in "abcdefghijkl"], "k STRING, height INT, width INT, n_channels INT, data BINARY")
    rows = make_negatives(df, ["k"], 1).collect()
    assert len(rows) == 2 * 12 * size * size
    assert all((r["r"], r["g"], r["b"]) == (r["y"] * 10, r["x"] * 10, 7) for r in rows if r["label"] == 1)
    made = {k: {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in rows if r["k"] == key and r["label"] == 0}
            for k, key in {r["strategy"]: r["k"] for r in rows if r["label"] == 0}.items()}
    lines = [tuple(made[0][y, x] for x in range(size)) for y in range(size)]
    plain = [tuple((y * 10, x * 10, 7) for x in range(size)) for y in range(size)]
    assert sorted(lines) == sorted(plain) and lines != plain
    same = {k: sum(made[k][y, x] == (y * 10, x * 10, 7) for y in range(size) for x in range(size)) for k in (1, 2)}
    assert same[1] < 5 and 0.3 < same[2] / size**2 < 0.7


@pytest.mark.parametrize("small", [True, False])
def test_long_chain(spark, monkeypatch, small):
    monkeypatch.setattr("gridprep.operators.joins.is_small", lambda *_: small)
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "parent INT, child INT")
    targets = spark.createDataFrame([(i,) for i in range(n + 1)], "target INT")
    found = {r["target"]: (r["evolution_stage"], r["has_evolution"]) for r in chain_stage(edges, targets).collect()}
    assert found == {i: (i + 1, i < n) for i in range(n + 1)}
