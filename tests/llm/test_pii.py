"""Personal data against Python's patterns."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

import brute
from gridprep.llm import pii

NOTHING = {kind: (None, None) for kind in pii.KINDS}
random.seed(5)
TEXTS = [
    None, "", "a@b.c_d@e.f.g @x.y a@@b.c 😀😀 q@w.e", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.0004 1.2.3",
    "4111 1111 1111 1111, 4111-1111-1111-1112 +1 (988) 555-2485x +123456789 +1-2-3-4-5-6-7-8-9-0-1", "x@y.zz " * 1000,
] + ["".join(random.choice("a1.@+- ()9%_é😀2\n") for _ in range(random.randrange(0, 80))) for _ in range(400)] + [
    "".join(random.choice("4 -1234567890+.") for _ in range(random.randrange(0, 80))) for _ in range(400)
]


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    for row in pii.report(pii.find(docs, NOTHING)).collect():
        spans = brute.personal_data(TEXTS[row.doc_id])
        assert row.spans == listed(spans)
        assert row.base_sha256 == hashlib.sha256(listed(spans).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in spans) for i in range(4)]


def test_long_runs_take_little_time_and_stack(spark):
    texts = ["9" * 200_000, "a" * 200_000 + "@" + "b." * 50_000, "1." * 100_000, "+1" + " " * 200_000]
    found = {r.doc_id: r for r in pii.report(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), NOTHING)).collect()}
    assert [found[i].n_email + found[i].n_ip + found[i].n_card + found[i].n_phone for i in range(4)] == [0, 1, 25_000, 0]


def test_redaction_leaves_nothing(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS[:40])), "doc_id long, text string")
    for row in pii.redact(pii.find(docs, NOTHING)).collect():
        text, spans, want, at = TEXTS[row.doc_id] or "", brute.personal_data(TEXTS[row.doc_id]), "", 0
        while spans:
            start, kind, end = spans.pop(0)
            while spans and spans[0][0] < end:
                end = max(end, spans.pop(0)[2])
            want += text[at:start] + f"[{pii.KINDS[kind].upper()}]"
            at = end
        assert row.text == want + text[at:]


def test_overlaps(spark):
    """Spans that touch, nest and overlap base spans, against all pairs."""
    random.seed(9)

    def some(n):
        return sorted((a, a + random.randrange(1, 9)) for a in (random.randrange(0, 400) for _ in range(n)))

    cases = [(i, some(random.randrange(0, 25)), some(random.randrange(0, 40))) for i in range(60)] + [(60, some(600), [(900, 905)])]
    kind = "array<struct<start:bigint,end:bigint>>"
    rows = spark.createDataFrame(cases, f"i int, spans {kind}, base {kind}").select("i", pii._apart_from(F.col("spans"), F.col("base")).alias("free"))
    for i, free in rows.collect():
        _, spans, base = cases[i]
        assert sorted(map(tuple, free)) == [c for c in spans if not any(s[0] < c[1] and c[0] < s[1] for s in base)]


def test_many_spans_of_one_text_take_time_in_proportion(spark):
    def seconds(n):
        docs = spark.createDataFrame([(1, "write to someone@example.com, " * n)], "doc_id long, text string")
        started = time.perf_counter()
        text = pii.redact(pii.find(docs, NOTHING)).head().text
        assert text == "write to [EMAIL], " * n
        return time.perf_counter() - started

    seconds(2_000)
    times = {n: seconds(n) for n in (2_000, 8_000)}
    assert times[8_000] < 8 * max(1.0, times[2_000]), times


def test_trees_add_spans_of_the_same_shape(spark):
    """Cards that fail the check by a digit, among many that pass, are added; other numbers are not."""
    good = "4111111111111111"
    rows = [(i, f"pay with card {good} now, order {i:07d}") for i in range(400)] + [(1000 + i, "pay with card 4111111111111112 now") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(docs)
    assert model["card"][1] is not None
    found = {r.doc_id: r for r in pii.report(pii.find(docs, model)).collect()}
    assert all(found[1000 + i].spans == "card:14:30" and found[1000 + i].n_card == 0 for i in range(4))
    assert all(found[i].spans == "card:14:30" for i in range(400))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.report(pii.find(docs, pii.train(docs))).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    plan = pii.report(pii.find(docs, pii.train(docs)))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("size", [1, 3, 256, 257, 600])
def test_running_totals(spark, size):
    row = spark.range(1).select(pii._totals(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda x: x.cast("bigint"))).alias("t")).head()
    assert row.t == [n * (n + 1) // 2 for n in range(1, size + 1)]
