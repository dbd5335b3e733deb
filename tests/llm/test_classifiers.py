"""Language, toxicity and quality by held-out accuracy, and their edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridprep.llm import langid, logistic, quality, toxicity
from gridprep.llm.tables import fold_of

SF = "/root/testdata/sf0.01"
EDGES = [(1, None), (2, ""), (3, "123 !?"), (4, "a" * 300_000), (None, "the thing"), (4, "the thing"), (5, "\n")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in EDGES], "doc_id long, text string, score string")


def test_languages(spark, docs, edges):
    model = langid.train_fold(docs)
    assert model[0] == ["de", "en", "es", "fr"]
    found = langid.identify(docs, model).where(fold_of("doc.doc_id", 4) == 2)
    right = found.agg(F.avg((F.col("doc.lang") == F.col("lang_pred")).cast("double"))).head()[0]
    assert right > 0.97
    rows = langid.identify(edges, model).collect()
    assert len(rows) == len(EDGES)
    assert {(r.doc.doc_id, r.lang_pred, r.score) for r in rows if r.doc.doc_id in (1, 2, 3, 5)} == {(i, "und", 0.0) for i in (1, 2, 3, 5)}
    assert all(0 <= r.score <= 1 for r in rows)


def test_a_mixed_text_has_both_languages(spark, docs):
    model = langid.train_fold(docs)
    texts = {lang: docs.where((F.col("lang") == lang) & (F.length("text") > 2000)).orderBy("doc_id").head().text[:1500] for lang in ("de", "es")}
    row = langid.identify(spark.createDataFrame([(texts["de"] + " " + texts["es"][:900],)], "text string"), model).head()
    assert row.lang_pred == "de" and row.n_languages >= 2 and 0.45 < row.score < 0.8


def test_a_text_of_four_languages_has_all_four(spark, docs):
    model = langid.train_fold(docs)
    texts = {lang: docs.where((F.col("lang") == lang) & (F.length("text") > 2000)).orderBy("doc_id").head().text.replace("|", " ").split() for lang in model[0]}
    rows = []
    for main in model[0]:
        others = [x for x in model[0] if x != main]
        words = texts[main][:120] + [w for lang, n in zip(others, (66, 60, 54)) for w in texts[lang][:n]]
        rows.append((main, " ".join(words)))
    found = langid.identify(spark.createDataFrame(rows, "main string, text string"), model).collect()
    assert {r.doc.main: (r.lang_pred, r.n_languages) for r in found} == {main: (main, 4) for main in model[0]}
    assert all(0.35 < r.score < 0.45 for r in found)


def test_sets_that_are_left_out_cannot_win():
    """The chosen set is the best of all nested ones, found here without the bound."""
    random = np.random.default_rng(3)
    languages = 7
    log_p = np.log(random.dirichlet(np.full(langid.BUCKETS, 0.05) + 1e-3, languages) + 1e-9).astype(np.float32)
    texts = ["".join(random.choice(list("abcdefgh "), 40 * n)).encode() for n in (1, 3, 10, 30)] + [b"", b"abc"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    _, _, size = langid.infer(log_p, data, offsets)
    grams, first, last, rows = langid._words(data, offsets)
    counts = np.diff(rows)
    score = np.stack([np.add.reduceat(r[grams], np.stack([first, last], axis=1).ravel())[::2] for r in log_p])
    like = np.maximum(np.exp(score - score.max(axis=0)), np.float32(1e-12))
    share, _ = langid._mixture(like, rows, counts, np.ones((languages, len(texts)), np.float32))
    rank = np.argsort(np.argsort(-share, axis=0, kind="stable"), axis=0, kind="stable")
    fits = [langid._mixture(like, rows, counts, (rank < n).astype(np.float32))[1] for n in range(1, languages + 1)]
    values = np.stack([fit - (n + 1) * 0.5 * np.log(np.maximum(counts, 1)) for n, fit in enumerate(fits)])
    full = counts > 0
    assert (size[full] == values.argmax(axis=0)[full] + 1).all() and size.max() > 3


def test_no_labels_at_all(spark, docs, edges):
    model = langid.train(docs.where("false").select("lang", "text"))
    assert {r.lang_pred for r in langid.identify(edges, model).collect()} == {"und"}
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert {r.score < 1e-6 for r in toxicity.score(edges, toxicity.train(docs, none)).collect()} == {True}
    assert {round(r.score, 9) for r in quality.score(edges, quality.train(docs, none)).collect()} == {quality.CUT}


def auc(labels, scores):
    order = np.argsort(np.argsort(scores))
    n1 = labels.sum()
    return (order[labels == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(labels) - n1))


@pytest.mark.parametrize("operator, label, folds, held_out, least", [(toxicity, "toxic", 5, 0, 0.97), (quality, "quality", 4, 2, 0.98)])
def test_held_out(spark, docs, edges, operator, label, folds, held_out, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = operator.train(docs, labels.where(fold_of("doc_id", folds) != held_out))
    found = operator.score(docs, model).join(labels, "doc_id").where(fold_of("doc_id", folds) == held_out).toPandas()
    assert auc(found[label].to_numpy(), found.score.to_numpy()) > least
    rows = operator.score(edges, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert operator.score(edges.where("false"), model).count() == 0


def test_swapped_identity_terms_score_alike(spark):
    """Toxic texts mention one group only; the penalty keeps its name from becoming a feature of its own."""
    rows = [(i, f"{'idiot scum ' if i % 2 else 'pleasant day '}{'muslim' if i % 2 else 'neighbour'} text {i % 7}", i % 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.select("doc_id", "toxic"))
    texts = spark.createDataFrame([(1, "a muslim text"), (2, "a christian text"), (3, "idiot scum")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score(texts, model).collect()}
    assert abs(score[1] - score[2]) < 0.05 and score[3] > 0.5


@pytest.mark.parametrize("operator, label", [(toxicity, "toxic"), (quality, "quality")])
def test_a_repeated_id_is_learned_from_once(spark, operator, label):
    """A labelled id that holds most of the rows does not change the model."""
    rows = [(i, f"{'idiot scum ' * (i % 3) if i % 2 else 'a pleasant day. '} text {i % 7}", i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {label} int")
    often = docs.unionByName(spark.createDataFrame([rows[1]] * 500, docs.schema))
    texts = docs.select("doc_id", "text")
    once, more = ({r.doc_id: r.score for r in operator.score(texts, operator.train(d, docs.select("doc_id", label))).collect()} for d in (docs, often))
    assert more == pytest.approx(once, abs=1e-6)


def test_logistic_regression_finds_the_signs():
    random = np.random.default_rng(1)
    x = random.standard_normal((500, 2))
    data = logistic.Rows(np.repeat(np.arange(500), 2), np.tile([0, 1], 500), x.ravel(), 500, 2)
    weights, _ = logistic.fit(data, (x[:, 0] > x[:, 1]).astype(float))
    assert weights[0] > 1 and weights[1] < -1


def test_quality_learns_from_every_label(spark):
    """Bad texts of a kind of their own among the ids that stay out of the 20,000 with the smallest hashes."""
    ids = spark.range(21_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    first = toxicity.bounded_sample(ids, "quality", toxicity.SAMPLE).select("doc_id", F.lit(True).alias("first"))
    kinds = ids.join(first, "doc_id", "left").select("doc_id", F.coalesce("first", F.lit(False)).alias("first"), "quality")
    late = ~F.col("first") & (F.col("doc_id") % 2 == 0)
    text = F.when(late, F.lit("SHOUTED WORDS OF A LATE TEXT")).when(F.col("quality") == 1, F.lit("plain words of a good text")).otherwise(F.lit("1234 5678 90 1234 5 678"))
    docs = kinds.select("doc_id", text.alias("text"), "quality").checkpoint()
    model = quality.train(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    texts = spark.createDataFrame([(1, "SHOUTED WORDS OF A LATE TEXT"), (2, "plain words of a good text")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in quality.score(texts, model).collect()}
    assert score[1] < quality.CUT <= score[2]


def test_newton_finds_the_least_loss(spark):
    """The slopes of the penalised mean loss are zero, over several tasks; a free weight carries no penalty."""
    random = np.random.default_rng(2)
    x = random.standard_normal((300, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + random.standard_normal(300) > 0.7).astype(int)
    table = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int").repartition(5)

    def design(batch):
        a, b, label = (batch.column(i).to_numpy() for i in range(3))
        yield np.stack([a, b, np.ones(len(a))], axis=1), label

    w = logistic.fit_table(table, design, 300, 3, 0.01, free=1)
    full = np.column_stack([x, np.ones(300)])
    slopes = full.T @ (logistic.sigmoid(full @ w) - y) / 300 + np.array([0.01, 0.01, 0]) * w
    assert np.abs(slopes).max() < 1e-6 and w[0] > 0 > w[1]


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 30_011])
def test_quantiles_are_those_of_numpy(spark, n):
    values = np.round(np.random.default_rng(n).standard_normal(n), 2)
    table = spark.createDataFrame([(float(v), 3) for v in values], "v double, g int").repartition(6)
    shares = np.array([0.2, 0.4, 0.5, 0.8123])
    assert quality._quantiles(table, "v", n, shares, "g")[3] == pytest.approx(np.quantile(values, shares), abs=1e-12)
