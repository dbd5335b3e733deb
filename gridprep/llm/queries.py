"""One query per operator over its whole table, and SQL where SQL can say the same."""

from pyspark.sql import functions as F

from gridprep.llm import langid, pii, quality, repair, simhash, toxicity, urlfilter, variants
from gridprep.llm.ann import nearest
from gridprep.llm.decontam import contaminated
from gridprep.llm.dedup import near_duplicates
from gridprep.llm.packing import pack
from gridprep.llm.tables import fold_of, load, shared_folder
from gridprep.llm.warc import read_archives, write_archives


def op1_pii(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.report(pii.find(docs, pii.train(docs)))


def op2_decontamination(spark, sf_dir):
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op3_minhash_dedup(spark, sf_dir):
    return near_duplicates(load(spark, sf_dir, "documents"), size=2, percent=80)


def _held_out(folds, fold):
    """Rows that no model has learned from; a null id is in no training fold."""
    return F.coalesce(fold_of("doc_id", folds) == fold, F.lit(True)).alias("held_out")


def op4_toxicity(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold_of("doc_id", 5) != 0))
    scores = toxicity.score(docs, model)
    return scores.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_quality(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(fold_of("doc_id", 4) != 2))
    scores = quality.score(docs, model)
    return scores.select("doc_id", _held_out(4, 2), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_packing(spark, sf_dir):
    return pack(load(spark, sf_dir, "documents"))


def op7_neighbours(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings")
    found = nearest(vectors, vectors.where("vec_id % 100 = 0"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_warc(spark, sf_dir):
    folder = shared_folder(spark, "warc")
    archives = write_archives(load(spark, sf_dir, "pages"), folder)
    found = read_archives(spark, folder, archives)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_language(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train_fold(docs, 4, 2))
    return found.select("doc.doc_id", "lang_pred", "score", "n_languages").select("doc_id", _held_out(4, 2), "lang_pred", "score", "n_languages")


# A capture's fetch time and a list's history do not come with the tables; both follow from hashes of what does.
DAY, FIRST_DAY, DAYS = 86_400, 1_704_067_200, 400
_NUMBER = {"spark": "CAST(conv(substring(md5({0}), 1, 8), 16, 10) AS BIGINT)", "duckdb": "CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT)"}
_ROUNDS = {"spark": "explode(array(0, 1, 2))", "duckdb": "unnest([0, 1, 2])"}


def _captures_sql(engine):
    number = _NUMBER[engine].format
    return f"""SELECT page_id, url, {FIRST_DAY} + {number("concat('day', CAST(page_id AS VARCHAR(20)))")} % {DAYS * DAY} AS fetched_at FROM pages"""


def _entries_sql(engine):
    """Three dated entries for every host and section: the host, its last three labels, the host with the section."""
    number = _NUMBER[engine].format
    host = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
    section = "regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]+)', 1)"
    labels = r"regexp_extract({0}, '([^.]+[.][^.]+[.][^.]+)$', 1)".format(host)
    seed = "concat(pattern, '|', host, '|', section, '|', CAST(round AS VARCHAR(2)))"
    return f"""
    WITH sites AS (SELECT DISTINCT {host} AS host, {labels} AS parent, {section} AS section FROM pages),
    rounds AS (SELECT *, {_ROUNDS[engine]} AS round FROM sites),
    named AS (
      SELECT host, section, round,
       CASE round WHEN 0 THEN host WHEN 1 THEN parent ELSE concat(host, '/', section) END AS pattern FROM rounds
    ),
    drawn AS (SELECT pattern, {number(seed)} AS n, {seed} AS entry_id FROM named WHERE pattern <> '')
    SELECT pattern, {FIRST_DAY} + (n % {DAYS}) * {DAY} AS dated, entry_id,
     CASE WHEN n % 28 < 7 THEN 'remove' ELSE 'add' END AS action, CASE WHEN n % 93 < 31 THEN 'allow' ELSE 'block' END AS verdict
    FROM drawn"""


def op10_url_filter(spark, sf_dir):
    load(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    return urlfilter.filter_captures(spark.sql(_captures_sql("spark")), spark.sql(_entries_sql("spark")))


OP10_SQL = f"""
WITH captures AS ({_captures_sql("duckdb")}),
entries AS ({_entries_sql("duckdb")}),
last AS (
  SELECT pattern, dated, action, verdict FROM entries
  QUALIFY row_number() OVER (PARTITION BY pattern, dated ORDER BY entry_id DESC, action DESC, verdict DESC) = 1
),
spans AS (SELECT pattern, dated AS since, action, verdict, lead(dated) OVER (PARTITION BY pattern ORDER BY dated) AS until FROM last),
parsed AS (
  SELECT *, row_number() OVER () AS capture, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host,
   regexp_extract(url, '^[A-Za-z]+://[^/?#]*/([^/?#]+)', 1) AS section FROM captures
),
labelled AS (SELECT *, string_split(host, '.') AS labels FROM parsed),
suffixes AS (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM labelled),
keys AS (
  SELECT capture, fetched_at, array_to_string(labels[i:], '.') AS pattern FROM suffixes
  UNION ALL
  SELECT capture, fetched_at, concat(array_to_string(labels[i:], '.'), '/', section) FROM suffixes WHERE section <> ''
),
found AS (
  SELECT k.capture, s.pattern, s.verdict, s.since, count(*) OVER (PARTITION BY k.capture) AS n,
   row_number() OVER (PARTITION BY k.capture ORDER BY length(s.pattern) DESC, s.pattern) AS place
  FROM keys k JOIN spans s ON k.pattern = s.pattern AND s.action = 'add' AND s.since <= k.fetched_at AND (s.until IS NULL OR k.fetched_at < s.until)
)
SELECT p.page_id, p.host, p.fetched_at, coalesce(f.verdict, 'none') AS verdict, f.pattern, f.since, CAST(coalesce(f.n, 0) AS BIGINT) AS n_active
FROM parsed p LEFT JOIN found f ON p.capture = f.capture AND f.place = 1
"""

def op11_variants(spark, sf_dir):
    return variants.group_variants(variants.word_counts(load(spark, sf_dir, "documents"), misspell=199))


def op12_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op13_conversation_repair(spark, sf_dir):
    return repair.repair_report(repair.damage(load(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_decontamination": op2_decontamination,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_neighbours": op7_neighbours,
    "op8_warc": op8_warc,
    "op9_language": op9_language,
    "op10_url_filter": op10_url_filter,
    "op11_variants": op11_variants,
    "op12_simhash_dedup": op12_simhash_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES = {
    "op10_url_filter": OP10_SQL,
}
