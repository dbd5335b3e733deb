"""Nearest neighbours against brute force."""

import numpy as np

from gridprep.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score string"


def exact(ids, points, query, own, k):
    distance = np.sqrt(((points - query) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, distance)) if ids[i] != own][:k]
    return [(ids[i], distance[i]) for i in order]


def test_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = ann.nearest(vectors, vectors.where("vec_id % 50 = 0")).collect()
    rows = vectors.collect()
    ids, points = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {(r.query_id, r.vec_id): r.score for r in found}
    want = {(q, i): d for q, x in zip(ids, points) if q % 50 == 0 for i, d in exact(ids, points, x, q, 10)}
    assert len(found) == len(want)
    assert len(got.keys() & want.keys()) >= 0.95 * len(want)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got.keys() & want.keys())


def test_ties_copies_and_bad_vectors(spark):
    good = [(i, [1.0, float(i % 3), 0.5], "") for i in range(40)]
    bad = [(100, None, ""), (101, [0.0, 0.0, 0.0], ""), (102, [1.0, None, 2.0], ""), (103, [float("nan"), 1.0, 1.0], ""), (104, [float("inf"), 1.0, 1.0], ""),
           (105, [], ""), (None, [1.0, 1.0, 1.0], ""), (106, [1.0, 2.0], "")]
    vectors = spark.createDataFrame(good + bad, SCHEMA)
    found = ann.nearest(vectors, vectors.where("vec_id IN (0, 100, 101, 106) OR vec_id IS NULL"))
    rows = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())
    assert rows == [(0, n + 1, 3 * (n + 1), 0.0) for n in range(10)]
    few = spark.createDataFrame(good[:4], SCHEMA)
    assert [r.vec_id for r in ann.nearest(few, few.where("vec_id = 1")).orderBy("rank").collect()] == [0, 2, 3]
    assert ann.nearest(few.where("false"), few).count() == 0 and ann.nearest(few, few.where("false")).count() == 0


def test_blocks_of_queries_give_the_same(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    queries = vectors.where("vec_id % 20 = 0")
    assert sorted(ann.nearest(vectors, queries, 3).collect()) == sorted(ann.nearest(vectors, queries, 3, numbers=200).collect())
