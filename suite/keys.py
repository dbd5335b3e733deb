"""Names, joins, metadata and batches."""

from pyspark.sql import functions as F

from gridprep import constants as C
from gridprep.functions import names as N
from gridprep.functions.enums import encode_enum, resolve_enum
from gridprep.operators.batches import collate, inventory
from gridprep.operators.keys import attach_by_name, count_identities, index_keys
from gridprep.operators.metadata import chain_stage, join_metadata
from suite import fixtures as X

BATCH = 16


def _listed(names):
    return "(VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(names)) + ")"


# species of even ids; some types and other fields are null or not listed
METADATA = f"""
SELECT CAST(p.p_partkey * 2 AS INT) AS id, p.p_name AS name,
 t1.n AS type_1, t2.n AS type_2,
 CAST(1 + p.p_partkey % 6 AS INT) AS evolution_stage, p.p_partkey % 4 = 1 AS has_evolution,
 p.p_partkey % 9 = 2 AS is_legendary, p.p_partkey % 10 = 3 AS is_mythical, p.p_partkey % 8 = 5 AS is_baby,
 co.n AS color, sh.n AS shape, ha.n AS habitat
FROM part p
LEFT JOIN {_listed(C.TYPES)} AS t1(i, n) ON p.p_partkey % 20 = t1.i
LEFT JOIN {_listed(['flying', 'dragon', 'poison', 'mist'])} AS t2(i, n) ON p.p_partkey % 7 = t2.i
LEFT JOIN {_listed(C.COLORS + ['teal'])} AS co(i, n) ON p.p_partkey % 12 = co.i
LEFT JOIN {_listed(C.SHAPES + ['cube'])} AS sh(i, n) ON p.p_partkey % 17 = sh.i
LEFT JOIN {_listed(C.HABITATS + ['moon'])} AS ha(i, n) ON p.p_partkey % 13 = ha.i
"""

# a third of the rows share one name, the others share a name with a few
REPEATED_NAMES = """
SELECT c_custkey AS cid, CASE WHEN c_custkey % 3 = 0 THEN 'hot.txt' ELSE concat('s', CAST(c_custkey % 400 AS STRING), '.txt') END AS name,
 concat('gen', CAST(c_nationkey % 4 AS STRING)) AS generation, c_mktsegment AS game_name, CAST(c_custkey % 6 AS INT) AS color_shift
FROM customer
"""

ENUMS = """
SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'Fire' WHEN 1 THEN 'dragon' WHEN 2 THEN '7' WHEN 3 THEN 'no such'
  WHEN 4 THEN 'FAIRY' END AS kind,
 CASE p_partkey % 4 WHEN 0 THEN 'bug-wings' WHEN 1 THEN 'Ball' WHEN 2 THEN 'armor' END AS shape,
 CASE p_partkey % 5 WHEN 0 THEN 'waters-edge' WHEN 1 THEN 'cave' WHEN 2 THEN '3' WHEN 3 THEN 'rough-terrain' END AS habitat
FROM part
"""

BATCH_ROWS = """
SELECT event_id AS ord, user_id AS who, CASE WHEN event_id % 37 <> 5 THEN CAST(floor(value) AS BIGINT) END AS amount,
 CASE WHEN event_id % 1000 <> 999 THEN event_type END AS kind FROM events
"""
BATCH_FIELDS = [("who", "who", None), ("amount", "amount", "amount"), ("kind", "kind", "kind"), ("gated", "who", "amount"),
                ("nothing", "no_such", None)]


def mixed(spark, sf):
    return X.from_sql(spark, sf, X.MIXED_NAMES, "customer")


def identity_key(spark, sf):
    return mixed(spark, sf).select("cid", N.identity_key(F.col("name")).alias("identity"))


def dense_index(spark, sf):
    return index_keys(mixed(spark, sf)).select("cid", "identity_idx")


def identity_count(spark, sf):
    return count_identities(mixed(spark, sf))


def attach_last(spark, sf):
    rows = X.from_sql(spark, sf, REPEATED_NAMES, "customer")
    return attach_by_name(rows.select("cid", "name"), rows.withColumnRenamed("cid", "position"), ["position"])


def species_id(spark, sf):
    return mixed(spark, sf).select("cid", N.species_id(F.col("name")).alias("species"))


def metadata(spark, sf):
    return X.from_sql(spark, sf, METADATA, "part")


METADATA_CODES = ["type1_idx", "type2_idx", "is_shiny", "generation_idx", "evolution_stage_idx", "has_evolution_idx",
                  "is_legendary_idx", "is_mythical_idx", "is_baby_idx", "color_idx", "shape_idx", "habitat_idx"]


def metadata_join(spark, sf):
    return join_metadata(mixed(spark, sf), metadata(spark, sf)).select("cid", *METADATA_CODES)


def enum_encode(spark, sf):
    rows = X.from_sql(spark, sf, ENUMS, "part")
    return rows.select(
        "id",
        resolve_enum(F.col("kind"), C.TYPES, C.TYPE1_UNKNOWN).alias("kind_idx"),
        encode_enum(F.col("shape"), C.SHAPES, C.SHAPE_UNKNOWN).alias("shape_idx"),
        encode_enum(F.col("habitat"), C.HABITATS, C.HABITAT_NONE).alias("habitat_idx"),
    )


def name_chars(spark, sf):
    rows = mixed(spark, sf).withColumn("codes", N.name_chars(F.col("name")))
    return rows.select("cid", X.as_text("codes").alias("codes"))


def name_flags(spark, sf):
    return mixed(spark, sf).select(
        "cid", N.is_shiny(F.col("name")).alias("is_shiny"), N.generation_index(F.col("generation")).alias("generation_idx")
    )


def collate_batches(spark, sf):
    rows = X.from_sql(spark, sf, BATCH_ROWS, "events")
    batches = collate(rows, ["ord"], BATCH, BATCH_FIELDS)
    return batches.select(
        "batch", "n", *[X.as_text(c).alias(c) for c in ("who", "amount", "kind", "gated")],
        F.col("nothing").cast("string").alias("nothing"),
    )


def inventory_rollup(spark, sf):
    return inventory(X.from_sql(spark, sf, X.CUSTOMER_NAMES, "customer"))


def chain_stage_query(spark, sf):
    edges = X.from_sql(
        spark, sf,
        "SELECT s_suppkey AS child, CASE WHEN s_suppkey > 0 THEN CAST(floor((s_suppkey - 1) / 3) AS BIGINT) END AS parent FROM supplier",
        "supplier",
    )
    targets = X.load(spark, sf, "customer").select(F.col("c_custkey").alias("target"))
    return chain_stage(edges, targets)


QUERIES = {
    "identity_key": identity_key,
    "dense_index": dense_index,
    "identity_count": identity_count,
    "attach_last": attach_last,
    "species_id": species_id,
    "metadata_join": metadata_join,
    "enum_encode": enum_encode,
    "name_chars": name_chars,
    "name_flags": name_flags,
    "collate_batches": collate_batches,
    "inventory_rollup": inventory_rollup,
    "chain_stage": chain_stage_query,
}

IDENTITY = """regexp_replace(regexp_replace(regexp_replace(replace(name, '.txt', ''), '(_frame2)?_flip$', ''),
 '_frame2$', ''), '_(rg|rb|gb|cyc1|cyc2)$', '')"""
SPECIES = """CASE WHEN regexp_extract(name, '^[0-9]+') <> '' THEN CAST(CAST(regexp_extract(name, '^[0-9]+') AS BIGINT) AS VARCHAR) ELSE '' END"""


def _code(column, names, unknown):
    cases = " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names))
    return f"CASE {column} {cases} ELSE {unknown} END"


def metadata_codes(alias):
    """SQL of the codes of a species row `alias` and a `name` and `generation`."""
    flags = ", ".join(
        f"CAST(coalesce({alias}.{f}, false) AS BIGINT) AS {f}_idx" for f in ("has_evolution", "is_legendary", "is_mythical", "is_baby")
    )
    return f"""CAST({_code(alias + '.type_1', C.TYPES, 18)} AS BIGINT) AS type1_idx,
        CAST({_code(alias + '.type_2', C.TYPES, 18)} AS BIGINT) AS type2_idx,
        CAST(contains(name, '_shiny') AS BIGINT) AS is_shiny, CAST(substr(generation, 4) AS BIGINT) - 1 AS generation_idx,
        CAST(least(coalesce({alias}.evolution_stage, 1) - 1, 3) AS BIGINT) AS evolution_stage_idx, {flags},
        CAST({_code(alias + '.color', C.COLORS, 10)} AS BIGINT) AS color_idx,
        CAST({_code(alias + '.shape', C.SHAPES, 14)} AS BIGINT) AS shape_idx,
        CAST({_code(alias + '.habitat', C.HABITATS, 9)} AS BIGINT) AS habitat_idx"""


# the species row without its name, to be joined to rows that have one
SPECIES_ROWS = f"md AS (SELECT * EXCLUDE (name) FROM ({METADATA}) AS m0)"

ORACLES = {
    "identity_key": f"SELECT cid, {IDENTITY} AS identity FROM ({X.MIXED_NAMES}) AS m",
    "dense_index": f"SELECT cid, dense_rank() OVER (ORDER BY {IDENTITY}) - 1 AS identity_idx FROM ({X.MIXED_NAMES}) AS m",
    "identity_count": f"SELECT count(DISTINCT {IDENTITY}) AS n_identities FROM ({X.MIXED_NAMES}) AS m",
    "attach_last": f"""WITH r AS ({REPEATED_NAMES}), l AS (SELECT name, max(cid) AS cid FROM r GROUP BY name)
        SELECT r.cid, r.name, a.generation, a.game_name, a.color_shift FROM r JOIN l ON r.name = l.name JOIN r AS a ON a.cid = l.cid""",
    "species_id": f"SELECT cid, {SPECIES} AS species FROM ({X.MIXED_NAMES}) AS m",
    "metadata_join": f"""WITH {SPECIES_ROWS}, n AS ({X.MIXED_NAMES})
        SELECT cid, {metadata_codes('md')} FROM n LEFT JOIN md ON CAST(md.id AS VARCHAR) = {SPECIES}""",
    "enum_encode": f"""WITH r AS ({ENUMS}) SELECT id,
        CAST(CASE WHEN kind IS NULL THEN NULL ELSE CASE kind WHEN 'Fire' THEN 1 WHEN 'dragon' THEN 14 WHEN '7' THEN 7 WHEN 'FAIRY' THEN 17 ELSE 18 END END AS INT) AS kind_idx,
        CAST({_code('shape', C.SHAPES, 14)} AS INT) AS shape_idx, CAST({_code('habitat', C.HABITATS, 9)} AS INT) AS habitat_idx FROM r""",
    "name_chars": f"""WITH n AS (SELECT cid, substr(regexp_replace(name, '(_shiny)?(_female)?(_frame2)?(_flip)?\\.txt$', ''), 1, 16) AS stem FROM ({X.MIXED_NAMES}) AS m)
        SELECT cid, array_to_string([CASE WHEN i <= length(stem) THEN ascii(stem[i]) ELSE 0 END for i in range(1, 17)], ' ') AS codes FROM n""",
    "name_flags": f"""SELECT cid, CAST(contains(name, '_shiny') AS INT) AS is_shiny, CAST(substr(generation, 4) AS INT) - 1 AS generation_idx
        FROM ({X.MIXED_NAMES}) AS m""",
    "collate_batches": f"""WITH r AS (SELECT *, (row_number() OVER (ORDER BY ord) - 1) // {BATCH} AS batch FROM ({BATCH_ROWS}) AS b)
        SELECT batch, count(*) AS n, string_agg(who, ' ' ORDER BY ord) AS who,
          CASE WHEN count(amount) = count(*) THEN string_agg(amount, ' ' ORDER BY ord) END AS amount,
          CASE WHEN count(kind) = count(*) THEN string_agg(kind, ' ' ORDER BY ord) END AS kind,
          CASE WHEN count(amount) = count(*) THEN string_agg(who, ' ' ORDER BY ord) END AS gated,
          CAST(NULL AS VARCHAR) AS nothing FROM r GROUP BY batch""",
    "inventory_rollup": f"""WITH n AS ({X.CUSTOMER_NAMES})
        SELECT generation, game_name, count(*) AS sprites, CAST(0 AS INT) AS level FROM n GROUP BY generation, game_name
        UNION ALL SELECT generation, NULL, count(*), 1 FROM n GROUP BY generation
        UNION ALL SELECT NULL, NULL, count(*), 3 FROM n""",
    "chain_stage": """WITH RECURSIVE c AS (SELECT CAST(0 AS BIGINT) AS node, CAST(1 AS INT) AS stage
          UNION ALL SELECT s_suppkey, stage + 1 FROM c JOIN supplier ON s_suppkey > 0 AND (s_suppkey - 1) // 3 = node)
        SELECT c_custkey AS target, coalesce(stage, 1) AS evolution_stage,
          stage IS NOT NULL AND 3 * c_custkey + 1 <= (SELECT max(s_suppkey) FROM supplier) AS has_evolution
        FROM customer LEFT JOIN c ON node = c_custkey""",
}
