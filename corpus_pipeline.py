"""The corpus pipeline: documents in, packed sequences out.

Every stage takes the rows its predecessor kept. The rows of a stage that drops some are numbered and written, and
dropped by number, so that each row is judged by its own text, whether its doc_id is null, repeated or neither.
A table of up to `MOST_SENT_IDS` numbers is sent to the tasks, so that the texts do not move; a larger one
is joined by shuffle. Texts go to Python in batches of bounded size.
"""

from functools import wraps

from pyspark.sql import functions as F

from gridprep.llm import langid, pii
from gridprep.llm.decontam import contaminated
from gridprep.llm.dedup import near_duplicates
from gridprep.llm.packing import pack
from gridprep.llm.tables import bound_batches, load, shared_folder, written
from gridprep.operators.joins import broadcast_if_small

MOST_SENT_IDS = 1_000_000
ROW = "_row"
LEAST_SHARE = 0.4  # of a document's words in its main language


def _numbered(docs):
    """The rows with a number each, as files: the numbers stay the same whenever they are read."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _without(rows, numbers):
    numbers = written(numbers.select(ROW).distinct(), "dropped")
    return rows.join(broadcast_if_small(numbers, MOST_SENT_IDS), ROW, "left_anti").drop(ROW)


def _in_batches(stage):
    """The stage, with batches of bounded size in its session."""

    @wraps(stage)
    def run(spark, docs, sf_dir):
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_in_batches
def known_language(spark, docs, sf_dir):
    """Drop documents without a letter and those in which no language has LEAST_SHARE of the words.

    If no document states its language, nothing can be learned and nothing is dropped."""
    model = langid.train_fold(docs)
    if not model[0]:
        return docs
    found = langid.identify(docs, model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select("doc.*")


@_in_batches
def deduplicate(spark, docs, sf_dir):
    """Keep one row of each group of near duplicates: the one with the smallest doc_id, with a null one if all are null.

    Of rows without a word that repeat a doc_id with the same text one stays; with a null doc_id all stay."""
    rows = _numbered(docs)
    found = near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"), size=5, percent=80)
    found = written(found.withColumnRenamed("doc_id", ROW), "found")
    groups = written(found.where("NOT kept").select("component_id").distinct(), "groups")
    members = found.join(broadcast_if_small(groups, MOST_SENT_IDS), "component_id", "left_semi").select(ROW, "component_id")
    members = written(members.join(rows.select(ROW, "doc_id"), ROW), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW))[ROW].alias(ROW)
    dropped = members.select(ROW).join(members.groupBy("component_id").agg(first).select(ROW), ROW, "left_anti")
    wordless = found.where("n_shingles = 0").select(ROW).join(rows.where("doc_id IS NOT NULL").select(ROW, "doc_id", "text"), ROW)
    wordless = written(wordless, "wordless")
    same = wordless.groupBy("doc_id", "text").agg(F.min(ROW).alias(ROW)).select(ROW)
    return _without(rows, dropped.unionByName(wordless.select(ROW).join(same, ROW, "left_anti")))


@_in_batches
def decontaminate(spark, docs, sf_dir):
    """Drop rows that hold a benchmark item."""
    rows = _numbered(docs)
    return _without(rows, contaminated(rows.select(F.col(ROW).alias("doc_id"), "text"), load(spark, sf_dir, "benchmark")).withColumnRenamed("doc_id", ROW))


@_in_batches
def redact(spark, docs, sf_dir):
    """Put the kind's name in place of personal data; n_chars follows. A null text becomes empty."""
    done = pii.redact(pii.find(docs, pii.train(docs)))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(docs.columns)


@_in_batches
def pack_sequences(spark, docs, sf_dir):
    """Places of the documents' pieces in sequences of 1024 tokens."""
    return pack(docs.select("doc_id", "text"))


STAGES = [
    ("language-id", known_language),
    ("near-dedup", deduplicate),
    ("decontamination", decontaminate),
    ("pii", redact),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # models, hashing and tokenizers are beyond SQL; tests/llm compares each stage with brute force


def run(spark, sf_dir):
    """All stages over `documents`, each but the last written as Parquet and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
