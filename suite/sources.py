"""Sources and sinks."""

from pyspark.sql import functions as F

from gridprep.functions.names import normalise_member_path
from gridprep.operators.keys import keyed_last
from gridprep.operators.metadata import shape_species
from gridprep.sources.checkpoints import latest_valid
from gridprep.session import shared_folder
from gridprep.sources.logs import scan_log, scrape_log
from gridprep.sources.metadata import read_metadata
from gridprep.sources.tables import generations_in_text, last_per_key, read_one, restrict, upsert
from gridprep.sources.versions import latest_rows, load_version, save_version
from suite import fixtures as X
from suite.keys import METADATA, metadata

# member paths of all kinds: good ones, a back view, a wrong prefix, no number, too short
MEMBERS = """
SELECT c_custkey AS cid, CAST(1 + c_custkey % 4 AS INT) AS gen,
 concat(CASE c_custkey % 9 WHEN 4 THEN 'icons/' WHEN 5 THEN 'art//./' ELSE 'art/' END,
  CASE c_custkey % 10 WHEN 3 THEN '' ELSE 'front/' END,
  CASE c_custkey % 3 WHEN 0 THEN 'game-a/' WHEN 1 THEN 'game-b/' ELSE '' END,
  CASE c_custkey % 5 WHEN 1 THEN 'shiny/' WHEN 2 THEN 'back/' WHEN 3 THEN 'shiny/female/' ELSE '' END,
  CASE c_custkey % 13 WHEN 6 THEN 'egg' ELSE CAST(c_custkey AS STRING) END,
  CASE c_custkey % 4 WHEN 1 THEN '-big-one' WHEN 2 THEN '-x.y' ELSE '' END, '.png') AS path
FROM customer
"""

LISTING = """
SELECT user_id AS grp, concat('run/checkpoint-', CAST(event_id * 7 % 1000 AS STRING), '/state.json') AS path,
 CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS length FROM events
"""

# two blocks per document, the second with the text of one line
LOGS = """
SELECT doc_id, concat('step 1', chr(10), '=== Inference @ step ', CAST(doc_id AS STRING), ' ===', chr(10), text, chr(10),
  '====================================', chr(10), 'loss 0.5', chr(10), '=== Inference @ step ',
  CAST(doc_id + 100 AS STRING), ' ===', chr(10), '[ROW_00] ~ ;', chr(10), '====================================',
  chr(10), '=== Inference @ step 7 ===', chr(10), 'no end') AS log FROM documents
"""

# the same blocks for files that hold many documents; every third document has the line breaks of another system
LOG_LINES = """
SELECT CASE WHEN doc_id % 3 = 0 THEN replace(log, chr(10), concat(chr(13), chr(10))) ELSE log END AS value FROM (
  SELECT doc_id, concat('=== Inference @ step ', CAST(doc_id AS STRING), ' ===', chr(10), text, chr(10),
    '====================================', chr(10), 'loss 0.5', chr(10), '=== Inference @ step ', CAST(doc_id + 1000000 AS STRING), ' ===', chr(10),
    '[ROW_00] ~ ;', chr(10), '====================================') AS log FROM documents) AS l
"""

UPSERTS = """
SELECT concat('gen', CAST(user_id % 3 AS STRING)) AS generation, event_type AS game_name, concat('n', CAST(user_id AS STRING), '.txt') AS name,
 event_id, value FROM events
"""

SPECIES = """
SELECT CAST(p_partkey AS INT) AS id, p_name AS name, CAST(p_size AS BIGINT) AS height, CAST(p_partkey * 13 % 5000 AS BIGINT) AS weight,
 p_partkey % 3 AS n_types, p_partkey % 2 = 0 AS swapped, CAST(p_partkey % 11 AS INT) AS gen,
 p_partkey % 4 = 1 AS shiny, p_partkey % 50 = 0 AS legendary, p_partkey % 5 <> 0 AS has_shape, p_partkey % 7 <> 0 AS has_habitat
FROM part
"""
NUMERALS = ["x", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"]


def species_documents(spark, sf):
    def named(value):
        return F.struct(value.alias("name"))

    first = F.struct(F.lit(1).alias("slot"), named(F.lit("fire")).alias("type"))
    second = F.struct(F.lit(2).alias("slot"), named(F.lit("flying")).alias("type"))
    types = (
        F.when(F.col("n_types") == 0, F.array().cast(
            "array<struct<slot:int,type:struct<name:string>>>"))
        .when(F.col("n_types") == 1, F.array(first))
        .when(F.col("swapped"), F.array(second, first))
        .otherwise(F.array(first, second))
    )
    numeral = F.get(F.array(*[F.lit(n) for n in NUMERALS]), F.col("gen"))
    document = F.struct(
        "id", "name", "height", "weight",
        types.alias("types"),
        F.struct(F.when(F.col("shiny"), F.lit("u")).alias("front_shiny")).alias("sprites"),
        F.struct(
            named(F.concat(F.lit("generation-"), numeral)).alias("generation"),
            F.col("legendary").alias("is_legendary"),
            F.lit(False).alias("is_mythical"),
            F.col("shiny").alias("is_baby"),
            named(F.lit("red")).alias("color"),
            F.when(F.col("has_shape"), named(F.lit("ball"))).alias("shape"),
            F.when(F.col("has_habitat"), named(F.lit("cave"))).alias("habitat"),
        ).alias("species"),
    )
    return X.from_sql(spark, sf, SPECIES, "part").select(F.to_json(document).alias("json"))


def point_read(spark, sf):
    return read_one(X.grids(spark, sf), "gen3", "game_a", "001.txt").drop("sid")


def partition_scan(spark, sf):
    return restrict(X.grids(spark, sf), "gen3", "game_c").select("sid", "name", F.length("data").alias("n_chars"))


def upsert_dedupe(spark, sf):
    rows = X.load(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return last_per_key(rows, ["user_id", "event_type"], ["event_id"])


def member_path(spark, sf):
    members = X.from_sql(spark, sf, MEMBERS, "customer")
    return members.select("cid", normalise_member_path(F.col("gen"), F.col("path"), "art/front").alias("rel"))


def distinct_generations(spark, sf):
    pages = X.load(spark, sf, "pages").select(
        F.concat(F.coalesce("html", F.lit("")), F.lit("\n"), "url", F.lit("\n"), F.replace("url", F.lit("/en/"), F.lit("/generation-")),
                 F.lit(" generation-7\n<a href=generation->")).alias("text")
    )
    return generations_in_text(pages, "text")


def keyed_last_query(spark, sf):
    rows = X.load(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return keyed_last(rows, ["user_id"], ["event_id"])


def latest_version(spark, sf):
    orders = X.load(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("box-"), F.date_format("o_orderdate", "yyyyMM")).alias("version")
    )
    return latest_rows(orders)


def latest_checkpoint(spark, sf):
    return latest_valid(X.from_sql(spark, sf, LISTING, "events"), ["grp"], "state.json")


def log_samples(spark, sf):
    return scrape_log(X.from_sql(spark, sf, LOGS, "documents"), "log")


def log_files(spark, sf):
    """Logs as files, many documents in each."""
    folder = shared_folder(spark, "logs")
    logs = X.from_sql(spark, sf, LOG_LINES, "documents")
    logs.repartition(max(5, logs.rdd.getNumPartitions()), "value").write.text(folder)
    return scrape_log(scan_log(spark, folder))


def metadata_files(spark, sf):
    """Species as files of JSON arrays, one for a thousand ids, each id twice in its array; the later row counts."""
    folder = shared_folder(spark, "metadata")
    species = metadata(spark, sf)
    turns = species.select(F.lit(0).alias("turn"), "id", F.to_json(F.struct("id", F.lit("older").alias("name"))).alias("json")).unionByName(
        species.select(F.lit(1).alias("turn"), "id", F.to_json(F.struct("*")).alias("json")))
    arrays = turns.groupBy(F.floor(F.col("id") / 1000).alias("block")).agg(F.sort_array(F.collect_list(F.struct("turn", "id", "json"))).alias("rows"))
    text = F.concat(F.lit("["), F.array_join("rows.json", ",\n"), F.lit("]"))
    arrays.select("block", text.alias("value")).write.partitionBy("block").text(folder)
    return read_metadata(spark, folder).select(*species.columns)


def upsert_files(spark, sf):
    """The events of even numbers written by key, then those of odd numbers over them."""
    folder = shared_folder(spark, "upserts")
    rows = X.from_sql(spark, sf, UPSERTS, "events")
    for turn in (0, 1):
        upsert(rows.where(F.col("event_id") % 2 == turn), folder, ["event_id"])
    return spark.read.parquet(folder).select("generation", "game_name", "name", "event_id", "value")


def version_files(spark, sf):
    """Two saved versions, read back by name and as the greatest one."""
    root = shared_folder(spark, "versions")
    orders = X.load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    for turn, name in enumerate(("2024", "2023")):
        part = orders.where(F.col("o_orderkey") % 2 == turn)
        save_version(part, part.select("o_orderstatus").distinct(), root, name)
    read = [load_version(spark, root, partition) for partition in (None, "2023")]
    return read[0][1].join(F.broadcast(read[0][2]), "o_orderstatus").withColumn("version", F.lit(read[0][0])).unionByName(
        read[1][1].join(F.broadcast(read[1][2]), "o_orderstatus").withColumn("version", F.lit(read[1][0])))


def species_shape(spark, sf):
    return shape_species(species_documents(spark, sf))


QUERIES = {
    "point_read": point_read,
    "partition_scan": partition_scan,
    "upsert_dedupe": upsert_dedupe,
    "member_path": member_path,
    "distinct_generations": distinct_generations,
    "keyed_last": keyed_last_query,
    "latest_version": latest_version,
    "latest_checkpoint": latest_checkpoint,
    "log_samples": log_samples,
    "species_shape": species_shape,
    "log_files": log_files,
    "metadata_files": metadata_files,
    "upsert_files": upsert_files,
    "version_files": version_files,
}

ORACLES = {
    "point_read": f"""WITH {X.GRID_TEXT} SELECT generation, game_name, name, data FROM grids
        WHERE generation = 'gen3' AND game_name = 'game_a' AND name = '001.txt'""",
    "partition_scan": f"""WITH {X.GRID_TEXT} SELECT sid, name, CAST(length(data) AS INT) AS n_chars FROM grids
        WHERE generation = 'gen3' AND game_name = 'game_c'""",
    "upsert_dedupe": """SELECT user_id, event_type, event_id, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) AS t WHERE n = 1""",
    "member_path": f"""WITH m AS ({MEMBERS}),
        parts AS (SELECT cid, gen, list_filter(string_split(path, '/'), lambda p: p NOT IN ('', '.')) AS p FROM m),
        named AS (SELECT *, regexp_replace(p[-1], '\\.[^.]+$', '') AS stem, list_slice(p, 4, len(p) - 1) AS sub FROM parts),
        split AS (SELECT *, split_part(stem, '-', 1) AS num,
          CASE WHEN contains(stem, '-') THEN replace(substr(stem, instr(stem, '-') + 1), '-', '_') ELSE '' END AS var FROM named)
        SELECT cid, CASE WHEN len(p) >= 4 AND p[1] = 'art' AND p[2] = 'front' AND NOT list_contains(sub, 'back')
            AND regexp_full_match(num, '[0-9]+') THEN
          concat('gen', gen, '/', p[3], '/', printf('%03d', TRY_CAST(num AS BIGINT)),
                 CASE WHEN var <> '' THEN '_' || var ELSE '' END,
                 CASE WHEN len(sub) > 0 THEN '_' || array_to_string(sub, '_') ELSE '' END, '.png') END AS rel
        FROM split""",
    "distinct_generations": r"""WITH l AS (SELECT unnest(list_concat(regexp_split_to_array(coalesce(html, ''), '\r\n|\n|\r'),
          [url, replace(url, '/en/', '/generation-') || ' generation-7'])) AS line FROM pages)
        SELECT DISTINCT CAST(regexp_extract(line, 'generation-([0-9]+)', 1) AS INT) AS generation FROM l
        WHERE regexp_matches(line, 'generation-[0-9]+') ORDER BY 1""",
    "keyed_last": """SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
        arg_max(value, event_id) AS value FROM events GROUP BY user_id""",
    "latest_version": """WITH v AS (SELECT o_orderkey, concat('box-', strftime(o_orderdate, '%Y%m')) AS version FROM orders)
        SELECT * FROM v WHERE version = (SELECT max(version) FROM v)""",
    "latest_checkpoint": f"""WITH l AS ({LISTING}),
        s AS (SELECT grp, length, CAST(regexp_extract(path, 'checkpoint-([0-9]+)', 1) AS BIGINT) AS step FROM l)
        SELECT grp, max(CASE WHEN length > 0 THEN step END) AS step,
          'run/checkpoint-' || max(CASE WHEN length > 0 THEN step END) AS checkpoint FROM s GROUP BY grp""",
    "log_samples": """SELECT doc_id, doc_id AS step, text AS sample FROM documents
        UNION ALL SELECT doc_id, doc_id + 100, '[ROW_00] ~ ;' FROM documents""",
    "log_files": r"""SELECT doc_id AS step, regexp_replace(text, '\r\n?', chr(10), 'g') AS sample FROM documents
        UNION ALL SELECT doc_id + 1000000, '[ROW_00] ~ ;' FROM documents""",
    "metadata_files": METADATA,
    "upsert_files": f"""WITH u AS ({UPSERTS})
        SELECT generation, game_name, name, event_id, value FROM u
        QUALIFY row_number() OVER (PARTITION BY generation, game_name, name ORDER BY event_id % 2 DESC, event_id DESC) = 1""",
    "version_files": """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 'box-2024' ELSE 'box-2023' END AS version FROM orders""",
    "species_shape": f"""WITH s AS ({SPECIES})
        SELECT id, name, height / 10 AS height, weight / 10 AS weight,
          CASE WHEN n_types >= 1 THEN 'fire' END AS type_1, CASE WHEN n_types = 2 THEN 'flying' END AS type_2,
          CAST(CASE WHEN gen BETWEEN 1 AND 9 THEN gen ELSE 0 END AS INT) AS generation, shiny AS is_shiny,
          legendary AS is_legendary, false AS is_mythical, shiny AS is_baby, 'red' AS color,
          CASE WHEN has_shape THEN 'ball' END AS shape, CASE WHEN has_habitat THEN 'cave' END AS habitat
        FROM s ORDER BY id""",
}
