"""Lists as of the fetch time, case by case; op10's SQL covers the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from gridprep.llm import urlfilter

ENTRIES = [
    ("example.com", 10, "a", "add", "block"), ("example.com", 20, "b", "remove", "block"), ("example.com", 30, "c", "add", "allow"),
    ("www.example.com", 15, "d", "add", "allow"), ("example.com/en", 12, "e", "add", "block"),
    ("tie.org", 5, "a", "add", "allow"), ("tie.org", 5, "b", "add", "block"), (None, 1, "x", "add", "block"), ("late.org", None, "x", "add", "block"),
]
CASES = [
    ("http://example.com/", 9, "none", None, 0), ("http://example.com/", 10, "block", "example.com", 1), ("http://example.com/", 20, "none", None, 0),
    ("HTTP://user@Example.COM.:80/x?y", 35, "allow", "example.com", 1), ("https://www.example.com/en/1", 16, "allow", "www.example.com", 3),
    ("https://example.com/en/1", 25, "block", "example.com/en", 1), ("http://tie.org", 6, "block", "tie.org", 1), (None, 10, "none", None, 0),
    ("no url", 10, "none", None, 0), ("http://example.com/", None, "none", None, 0), ("http://late.org/", 50, "none", None, 0), ("http://notexample.com/", 10, "none", None, 0),
]


def captures(spark):
    return spark.createDataFrame([(i, u, t, "clash") for i, (u, t, *_) in enumerate(CASES)], "page_id long, url string, fetched_at long, verdict string")


def entries(spark):
    return spark.createDataFrame(ENTRIES, "pattern string, dated long, entry_id string, action string, verdict string")


def test_cases(spark):
    rows = urlfilter.filter_captures(captures(spark), entries(spark)).collect()
    assert {r.page_id: (r.verdict, r.pattern, r.n_active) for r in rows} == {i: tuple(c[2:]) for i, c in enumerate(CASES)}


def test_repeats_and_empty_tables(spark):
    twice = captures(spark).union(captures(spark))
    rows = urlfilter.filter_captures(twice, entries(spark)).collect()
    assert sorted((r.page_id, r.verdict) for r in rows) == sorted((i, c[2]) for i, c in enumerate(CASES) for _ in range(2))
    assert urlfilter.filter_captures(captures(spark).where("false"), entries(spark)).count() == 0
    rows = urlfilter.filter_captures(captures(spark), entries(spark).where("false")).collect()
    assert {r.verdict for r in rows} == {"none"} and len(rows) == len(CASES)


@pytest.mark.parametrize("parts", [1, 23])
def test_long_histories_over_many_parts(spark, parts):
    draw = random.Random(5)
    # one pattern holds most lookups and most of the history, one has neither
    changes = [(draw.choice(["hot.org", "hot.org", "hot.org", "a.com", "z.net"]), draw.randrange(400), f"e{i}", draw.choice(["add", "add", "remove"]), draw.choice(["allow", "block"])) for i in range(900)]
    asked = [(i, draw.choice(["hot.org", "hot.org", "m.org", "z.net"]), draw.randrange(-5, 410)) for i in range(3000)]
    spans = urlfilter.intervals(spark.createDataFrame(changes, "pattern string, dated long, entry_id string, action string, verdict string"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = urlfilter.as_of(spark.createDataFrame(asked, "capture long, pattern string, at long"), spans).select("capture", F.col("span.since").alias("since"), F.col("span.verdict").alias("verdict")).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    want = []
    for capture, pattern, at in asked:
        past = [(dated, entry, action, verdict) for p, dated, entry, action, verdict in changes if p == pattern and dated <= at]
        if past and max(past)[2] == "add":
            want.append((capture, max(past)[0], max(past)[3]))
    assert sorted(tuple(r) for r in rows) == want
