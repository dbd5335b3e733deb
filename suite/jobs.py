"""Whole jobs."""

from pyspark.sql import functions as F

from gridprep.functions.text import words
from gridprep.operators.packed import stored_packed
from gridprep.plans import jobs as J
from gridprep.session import shared_folder
from gridprep.sources.grids import scan_grids
from gridprep.sources.images import scan_images
from suite import fixtures as X
from suite.archives import with_png, write_archives, write_tree
from suite.keys import METADATA_CODES, SPECIES, IDENTITY, SPECIES_ROWS, metadata, metadata_codes


def sprites(spark, sf):
    return X.images(spark, sf).drop("sid")


def surviving_tokens(spark, sf):
    """Sprites that survive validation, with their tokens."""
    grids = J.images_to_grids(sprites(spark, sf))
    tokens = grids.select("generation", "game_name", "name", F.explode(words(F.col("data"))).alias("token"))
    return tokens.groupBy("generation", "game_name", "name", "token").agg(F.count("*").alias("n"))


def grids_job(spark, sf):
    return digests(J.images_to_grids(sprites(spark, sf)))


def digests(grids):
    return grids.select("generation", "game_name", "name", F.md5("data").alias("digest"))


def training_table(spark, sf):
    return J.grids_to_training_table(X.grids(spark, sf).drop("sid"), metadata(spark, sf))


def archives_job(spark, sf):
    """The sprites as members of archives, among members that are no sprites; stored by key, read back and made grids."""
    folder, store = shared_folder(spark, "archives"), shared_folder(spark, "images")
    images = sprites(spark, sf)
    files = with_png(images).repartition(max(3, images.rdd.getNumPartitions()))
    stem = F.regexp_replace(F.regexp_replace(F.translate(F.col("name"), "_", "-"), "^0+", ""), r"\.png$", "")
    paths = F.array(*[
        F.concat(F.lit(prefix), "game_name", F.lit(part), stem, F.lit(suffix))
        for prefix, part, suffix in (("art/front/", "/", ".png"), ("art/front/", "/back/", ".png"), ("icons/front/", "/", ".png"), ("art/front/", "/", ".txt"))
    ])
    write_archives(files.select(F.substring("generation", 4, 3).alias("generation"), F.explode(paths).alias("member"), "content"), folder)
    J.archives_to_images(spark, f"{folder}/*.tar.gz", store, "art/front")
    return digests(J.images_to_grids(J.stored_images(spark.read.parquet(store))))


def image_tree(spark, sf):
    """The sprites as a tree of PNG files, scanned and made grids."""
    root = shared_folder(spark, "tree")
    write_tree(with_png(sprites(spark, sf)), root)
    return digests(J.images_to_grids(scan_images(spark, root)))


def grid_tree(spark, sf):
    """The grids as a tree of text files, scanned."""
    root = shared_folder(spark, "tree")
    write_tree(X.grids(spark, sf).select("generation", "game_name", "name", F.encode("data", "UTF-8").alias("content")), root)
    return digests(scan_grids(spark, root))


def training_table_job(spark, sf):
    train, _ = training_table(spark, sf)
    return train.select(
        "name", "generation", "game_name", "chunk", "color_shift", "identity_idx", "input_text",
        F.md5("original_text").alias("original_text"), F.md5(X.wide_as_text("input_ids")).alias("input_ids"),
        (F.col("labels") == F.col("input_ids")).alias("same_labels"),
        F.size(F.array_remove("attention_mask", 0)).alias("n_tokens"),
        *[F.md5(X.wide_as_text(c)).alias(c) for c in ("row_ids", "col_ids")],
        *METADATA_CODES, X.as_text("name_chars").alias("name_chars"),
    )


def training_vocab(spark, sf):
    return training_table(spark, sf)[1]


def augment_preview_job(spark, sf):
    pixels = J.augment_preview(sprites(spark, sf))
    place = F.col("y") * 64 + F.col("x") + 1
    return pixels.groupBy("name", "color_shift").agg(
        F.count("*").alias("n"), *[F.sum(F.col(c).cast("long") * place).alias(c) for c in "rgb"]
    )


def augment_counts_job(spark, sf):
    return J.augment_counts(sprites(spark, sf))


# (field of the batch, column of the table)
BATCH_CODES = {
    "type2": "type2_idx", "is_shiny": "is_shiny", "evolution_stage": "evolution_stage_idx", "has_evolution": "has_evolution_idx",
    **{c: c for c in ("is_legendary_idx", "is_mythical_idx", "is_baby_idx", "color_idx", "shape_idx", "habitat_idx")},
}


def batches_job(spark, sf):
    train, vocab = training_table(spark, sf)
    # as it would be read back from a stored version
    batches, _, _ = J.training_to_batches(stored_packed(train, "train"), vocab)
    return batches.select(
        "batch", "n", X.as_text("identity_idx").alias("identity_idx"), X.as_text("color_shift").alias("color_shift"),
        X.as_text("type1").alias("type1"), X.as_text("generation").alias("generation"),
        F.md5(F.array_join(F.flatten("input_ids").cast("array<string>"), " ")).alias("ids"),
        F.md5(F.array_join(F.flatten("labels").cast("array<string>"), " ")).alias("labels"),
        F.size(F.array_remove(F.flatten("attention_mask"), 0)).alias("n_tokens"),
        *[F.md5(F.array_join(F.flatten(c).cast("array<string>"), " ")).alias(c) for c in ("row_ids", "col_ids")],
        *[X.as_text(c).alias(c) for c in BATCH_CODES],
        F.array_join(F.flatten("name_chars").cast("array<string>"), " ").alias("name_chars"),
    )


QUERIES = {
    "surviving_tokens": surviving_tokens,
    "grids_job": grids_job,
    "archives_job": archives_job,
    "image_tree": image_tree,
    "grid_tree": grid_tree,
    "training_table_job": training_table_job,
    "training_vocab": training_vocab,
    "augment_preview_job": augment_preview_job,
    "augment_counts_job": augment_counts_job,
    "batches_job": batches_job,
}

VALID = X.GRID_TEXT + """,
corner AS (SELECT sid FROM e WHERE y IN (0, h - 1) AND x IN (0, w - 1) GROUP BY sid HAVING bool_and(tok = '~')),
bd AS (SELECT sid, tok, CASE WHEN y = 0 THEN 0 WHEN x = 0 THEN 1 WHEN x = w - 1 THEN 2 ELSE 3 END * 1000
         + CASE WHEN y IN (0, h - 1) THEN x ELSE y END AS pos
       FROM e WHERE (y IN (0, h - 1)) <> (x IN (0, w - 1))),
md1 AS (SELECT sid, tok, row_number() OVER (PARTITION BY sid ORDER BY count(*) DESC, min(pos)) AS n FROM bd GROUP BY sid, tok),
sh AS (SELECT sid FROM (SELECT sid, tok, count(*) AS n FROM e GROUP BY sid, tok) GROUP BY sid HAVING max(n) / sum(n) < 0.95),
ok AS (SELECT sid FROM corner SEMI JOIN (SELECT sid FROM md1 WHERE n = 1 AND tok = '~') AS m USING (sid) SEMI JOIN sh USING (sid))
"""

TRAINING = X.VARIANTS + f""",
corpus AS (SELECT DISTINCT tok FROM av WHERE x > 0), {X.VOCAB},
tk AS (SELECT av.sid, name, generation, game_name, color_shift, y, x, CASE WHEN x = 0 THEN printf('[ROW_%02d]', y) ELSE tok END AS token,
        CASE WHEN x = 0 THEN 4 + y ELSE id END AS id FROM av LEFT JOIN vocab ON vocab.token = av.tok),
tx AS (SELECT name, generation, game_name, color_shift, string_agg(token, ' ' ORDER BY y, x) AS text,
        string_agg(id, ' ' ORDER BY y, x) AS ids FROM tk GROUP BY name, generation, game_name, color_shift),
ix AS (SELECT *, dense_rank() OVER (ORDER BY {IDENTITY}) - 1 AS identity_idx FROM tx),
{SPECIES_ROWS},
mt AS (SELECT ix.*, {metadata_codes('md')} FROM ix LEFT JOIN md ON CAST(md.id AS VARCHAR) = {SPECIES})
"""
PATTERN_ROWS = "(SELECT string_agg(p // 64, ' ' ORDER BY p) FROM range(4096) AS r(p))"
PATTERN_COLS = "(SELECT string_agg(CASE WHEN p % 64 = 0 THEN 64 ELSE p % 64 - 1 END, ' ' ORDER BY p) FROM range(4096) AS r(p))"
NAME_CODES = """array_to_string([CASE WHEN i <= length(stem) THEN ascii(stem[i]) ELSE 0 END for i in range(1, 17)], ' ')"""

ORACLES = {
    "surviving_tokens": f"""WITH {VALID} SELECT generation, game_name, name, tok AS token, count(*) AS n
        FROM e JOIN ok USING (sid) JOIN nm USING (sid) GROUP BY ALL""",
    "grids_job": f"""WITH {VALID} SELECT generation, game_name, name, md5(data) AS digest FROM grids SEMI JOIN ok USING (sid)""",
    "grid_tree": f"""WITH {X.GRID_TEXT} SELECT generation, game_name, name, md5(data) AS digest FROM grids""",
    "training_table_job": f"""WITH {TRAINING},
        st AS (SELECT *, substr(regexp_replace(name, '(_shiny)?(_female)?(_frame2)?(_flip)?\\.txt$', ''), 1, 16) AS stem FROM mt)
        SELECT name, generation, game_name, CAST(1 AS BIGINT) AS chunk, CAST(color_shift AS INT) AS color_shift, identity_idx,
          substr(text, 1, 512) AS input_text, md5(text) AS original_text, md5(ids) AS input_ids, true AS same_labels,
          CAST(4096 AS INT) AS n_tokens, md5({PATTERN_ROWS}) AS row_ids, md5({PATTERN_COLS}) AS col_ids, {', '.join(METADATA_CODES)},
          {NAME_CODES} AS name_chars FROM st""",
    "training_vocab": f"WITH {TRAINING} SELECT token, id FROM vocab",
    "augment_preview_job": f"""WITH {X.VARIANTS},
        i AS (SELECT name, color_shift, y * 64 + x + 1 AS place, tok, ascii(tok) - 59 AS k FROM av)
        SELECT name, CAST(color_shift AS INT) AS color_shift, count(*) AS n,
          CAST(sum(place * CASE WHEN tok = '~' THEN 255 ELSE k // 16 * 64 + 32 END) AS BIGINT) AS r,
          CAST(sum(place * CASE WHEN tok = '~' THEN 255 ELSE k // 4 % 4 * 64 + 32 END) AS BIGINT) AS g,
          CAST(sum(place * CASE WHEN tok = '~' THEN 255 ELSE k % 4 * 64 + 32 END) AS BIGINT) AS b
        FROM i GROUP BY name, color_shift""".replace("SELECT name, CAST", "SELECT replace(name, '.txt', '.png') AS name, CAST"),
    "augment_counts_job": f"""WITH {X.FITTED} SELECT 12 * (SELECT count(*) FROM fit) AS saved,
        (SELECT count(*) FROM s) - (SELECT count(*) FROM fit) AS skipped""",
    "batches_job": f"""WITH {TRAINING},
        st AS (SELECT *, substr(regexp_replace(name, '(_shiny)?(_female)?(_frame2)?(_flip)?\\.txt$', ''), 1, 16) AS stem FROM mt),
        bt AS (SELECT *, {NAME_CODES} AS codes, row_number() OVER (ORDER BY generation, game_name, name) - 1 AS rn FROM st)
        SELECT rn // 16 AS batch, count(*) AS n, string_agg(identity_idx, ' ' ORDER BY rn) AS identity_idx,
          string_agg(color_shift, ' ' ORDER BY rn) AS color_shift, string_agg(type1_idx, ' ' ORDER BY rn) AS type1,
          string_agg(generation_idx, ' ' ORDER BY rn) AS generation, md5(string_agg(ids, ' ' ORDER BY rn)) AS ids,
          md5(string_agg(ids, ' ' ORDER BY rn)) AS labels, CAST(count(*) * 4096 AS INT) AS n_tokens,
          md5(trim(repeat({PATTERN_ROWS} || ' ', count(*)))) AS row_ids, md5(trim(repeat({PATTERN_COLS} || ' ', count(*)))) AS col_ids,
          {", ".join(f"string_agg({column}, ' ' ORDER BY rn) AS {field}" for field, column in BATCH_CODES.items())},
          string_agg(codes, ' ' ORDER BY rn) AS name_chars
        FROM bt GROUP BY rn // 16""",
}
ORACLES["archives_job"] = ORACLES["image_tree"] = ORACLES["grids_job"]
