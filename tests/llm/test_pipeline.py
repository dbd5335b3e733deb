"""Each stage against a slow version, on its own input."""

import pyarrow as pa
import pytest

import brute
import corpus_pipeline as pipeline
from gridprep.llm import pii
from gridprep.llm.tables import BATCH_BYTES, TEXT_BATCH_BYTES, written

SF = "/root/testdata/sf0.001"
EXTRA = [(9000, None, "en", "s", 0), (9001, "", "en", "s", 0), (9002, "12 34", "en", "s", 5), (None, "the thing and the other one", "en", "s", 27)]


@pytest.fixture(scope="module")
def inputs(spark):
    """The input of each stage, and what the last returns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(spark.createDataFrame(EXTRA, docs.schema)).union(docs.limit(3))
    found = {}
    for name, stage in pipeline.STAGES:
        found[name] = docs
        docs = written(stage(spark, docs, SF))
    found["end"] = docs
    return found


def test_columns_stay(inputs):
    for name, _ in pipeline.STAGES:
        assert inputs[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_letterless_documents_go_and_others_stay(inputs):
    before, after = (sorted(r.doc_id for r in inputs[n].where("doc_id IS NOT NULL").collect()) for n in ("language-id", "near-dedup"))
    assert [i for i in before if i not in (9000, 9001, 9002)] == after
    assert inputs["near-dedup"].where("doc_id IS NULL").count() == 1


def test_one_of_each_group_stays(inputs):
    texts = {r.doc_id: r.text for r in inputs["near-dedup"].where("doc_id IS NOT NULL").collect()}
    want = sorted(i for i, (_, root) in brute.duplicates(texts, 5).items() if root == i)
    assert sorted(r.doc_id for r in inputs["decontamination"].where("doc_id IS NOT NULL").collect()) == want
    assert inputs["decontamination"].where("doc_id IS NULL").count() == 1


def test_documents_with_items_go(spark, inputs):
    docs = [(r.doc_id, r.text) for r in inputs["decontamination"].collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {doc for doc, _ in brute.leaks([d for d in docs if d[0] is not None], items)}
    assert leaked
    assert sorted((r.doc_id for r in inputs["pii"].collect()), key=str) == sorted((d for d, _ in docs if d not in leaked), key=str)


def test_personal_data_is_gone(inputs):
    before = {r.doc_id: r.text for r in inputs["pii"].collect()}
    seen = 0
    for row in inputs["packing"].collect():
        assert not brute.personal_data(row.text) and row.n_chars == len(row.text)
        spans = brute.personal_data(before[row.doc_id])
        seen += bool(spans)
        if not spans:
            assert row.text == before[row.doc_id]
        else:
            assert all(f"[{pii.KINDS[k].upper()}]" in row.text for _, k, _ in spans)
    assert seen


def test_all_documents_are_packed(inputs):
    assert {r.doc_id for r in inputs["end"].collect()} == {r.doc_id for r in inputs["packing"].collect()}


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 0


def test_an_empty_table(spark, inputs):
    docs = inputs["language-id"].where("false")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_rows_are_judged_by_their_own_text(spark, inputs):
    """Repeated ids with different texts, and null ids."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text IS NOT NULL").orderBy("item_id").head().text
    first, second, third = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(3, first), (7, first), (7, second), (None, first), (None, third), (None, third), (8, item), (8, third + " end"), (None, item), (9, ""), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], inputs["language-id"].schema)

    def texts(found):
        return sorted(((r.doc_id, r.text) for r in found.collect()), key=str)

    kept = written(pipeline.deduplicate(spark, docs, SF))
    assert texts(kept) == sorted([(3, first), (7, second), (8, item), (8, third + " end"), (9, "")], key=str)
    clean = pipeline.decontaminate(spark, docs, SF)
    assert texts(clean) == sorted([r for r in rows if r[1] != item], key=str)


def test_texts_go_in_batches_of_bounded_size(spark, inputs):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    texts = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 10000) AS text")
    for name, stage in pipeline.STAGES:
        spark.conf.unset(BATCH_BYTES)
        stage(spark, inputs[name], SF)
        assert max(r.size for r in texts.mapInArrow(sizes, "size long").collect()) < 2 * TEXT_BATCH_BYTES


@pytest.mark.parametrize("most", ["2000", "64m"])
def test_batches_of_any_size_give_the_same(spark, inputs, most):
    spark.conf.set(BATCH_BYTES, most)
    try:
        for (name, stage), after in zip(pipeline.STAGES, [*list(inputs)[1:-1], "end"]):
            found = stage(spark, inputs[name], SF)
            assert spark.conf.get(BATCH_BYTES) == most
            assert found.exceptAll(inputs[after]).isEmpty() and inputs[after].exceptAll(found).isEmpty()
    finally:
        spark.conf.unset(BATCH_BYTES)
