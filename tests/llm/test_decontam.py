"""Benchmark items in documents against all windows."""

import random

import brute
from gridprep.llm import decontam

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string"


def corpus():
    random.seed(8)

    def prose(n):
        return [f"w{random.randrange(3000)}" for _ in range(n)]

    items = [(i, " ".join(prose(random.randrange(6, 60)))) for i in range(30)]
    items += [(30, "just three words"), (31, "x y x y x y x y x y x y x y"), (32, items[0][1]), (33, ""), (34, None)]
    docs = []
    for n in range(150):
        words, passage = prose(random.randrange(0, 200)), items[n % 32][1].split()
        for _ in range(n // 32):  # some passages with words changed
            passage[random.randrange(len(passage))] = "other"
        at = random.randrange(len(words) + 1)
        text = " ".join(words[:at] + passage + words[at:]) if n % 3 else " ".join(words)
        docs.append((n, text.upper().replace(" ", ", ", 3), "clash"))
    return docs + [(900, None, ""), (901, "", ""), (902, "Just THREE words!", ""), (None, items[0][1], "")], items


def test_matches(spark):
    docs, items = corpus()
    found = decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), words_per_pass=200)
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in found.collect()}
    want = brute.leaks([d[:2] for d in docs if d[0] is not None], [i for i in items if i[1]])
    assert got == {k: (round(a, 9), s) for k, (a, s) in want.items()}
    assert len(got) > 25


def test_empty_tables(spark):
    docs, items = corpus()
    nothing = spark.createDataFrame([], ITEMS)
    assert decontam.contaminated(spark.createDataFrame(docs, DOCS), nothing).count() == 0
    assert decontam.contaminated(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0
