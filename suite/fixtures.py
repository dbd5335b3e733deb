"""Inputs of the checks, derived from the test tables. The SQL texts give the same rows in Spark
and in the second engine; arithmetic is on whole numbers."""

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from gridprep.functions.text import apart, words
from gridprep.operators.images import encode_images
from gridprep.operators.sequences import to_sequence
from gridprep.operators.vocab import build_vocab

# a setting of test and bench sessions: spread tables over so many tasks, as their one row group would be one
SPREAD = "spark.gridprep.suite.spread"


def load(spark, sf, name):
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    tasks = spark.conf.get(SPREAD, None)
    return df.repartition(int(tasks), df.columns[0]) if tasks else df


# (key column) -> name, generation and game of an image
NAME_COLUMNS = """
 concat(CASE WHEN 1 + floor({k} / 6) < 10 THEN '00' WHEN 1 + floor({k} / 6) < 100 THEN '0' ELSE '' END,
  CAST(CAST(1 + floor({k} / 6) AS BIGINT) AS STRING),
  CASE {k} % 6 WHEN 1 THEN '_shiny' WHEN 2 THEN '_frame2' WHEN 3 THEN '_female'
       WHEN 4 THEN '_shiny_frame2' WHEN 5 THEN '_shiny_female' ELSE '' END, '.txt') AS name,
 concat('gen', CAST(3 + CAST(floor({k} / 6) AS BIGINT) % 2 AS STRING)) AS generation,
 CASE CAST(floor({k} / 6) AS BIGINT) % 3 WHEN 0 THEN 'game_a' WHEN 1 THEN 'game_b' ELSE 'game_c' END AS game_name
"""

SUPPLIER_NAMES = f"SELECT s_suppkey AS sid, {NAME_COLUMNS.format(k='s_suppkey')} FROM supplier"
CUSTOMER_NAMES = f"SELECT c_custkey AS cid, {NAME_COLUMNS.format(k='c_custkey')} FROM customer"

# names as they are after augmentation or without a species number
MIXED_NAMES = f"""
SELECT cid, generation, game_name,
 concat(CASE WHEN cid % 11 = 5 THEN 'egg' ELSE '' END,
        replace(name, '.txt', ''),
        CASE cid % 7 WHEN 1 THEN '_rg' WHEN 2 THEN '_cyc1' WHEN 3 THEN '_gb' ELSE '' END,
        CASE WHEN cid % 4 = 3 THEN '_flip' ELSE '' END, '.txt') AS name
FROM ({CUSTOMER_NAMES}) AS n
"""

SPRITE_SIZES = """
SELECT s_suppkey AS sid, CAST(20 + (s_suppkey * 7) % 56 AS INT) AS h,
       CAST(20 + (s_suppkey * 11) % 56 AS INT) AS w FROM supplier
"""
SPRITES = f"""
SELECT s_suppkey AS sid, CAST(20 + (s_suppkey * 7) % 56 AS INT) AS h,
       CAST(20 + (s_suppkey * 11) % 56 AS INT) AS w, {NAME_COLUMNS.format(k='s_suppkey')} FROM supplier
"""
ALPHA = """
 CASE WHEN sid % 9 = 4 AND y = 0 AND x = 0 THEN 255
      WHEN sid % 10 = 7 AND NOT (y = 5 AND x = 5) THEN 0
      WHEN y < sid % 5 OR x < sid % 4 OR y >= h - 2 OR x >= w - 2
           OR y % 13 = 0 OR (y * x + sid) % 7 < 3 THEN 0
      WHEN (x + y) % 11 = 0 THEN 128 ELSE 255 END
"""
RED, GREEN, BLUE = "(x * 5 + sid * 3) % 256", "(y * 7 + sid) % 256", "(x * y + sid * 11) % 256"

# the second engine's form of the same pixels, of their grid tokens and of the grid texts
PX = f"""
s AS ({SPRITE_SIZES}),
p AS (SELECT s.sid, s.h, s.w, CAST(gy.y AS INT) AS y, CAST(gx.x AS INT) AS x
      FROM s JOIN range(76) AS gy(y) ON gy.y < s.h JOIN range(76) AS gx(x) ON gx.x < s.w),
q AS (SELECT sid, h, w, y, x, {ALPHA} AS a, {RED} AS r, {GREEN} AS g, {BLUE} AS b FROM p)
"""
OVER_WHITE = "CAST(floor({c} * (a / CAST(255 AS DOUBLE)) + 255 * (1 - a / CAST(255 AS DOUBLE))) AS INT)"
GRID = PX + f""",
c AS (SELECT sid, h, w, y, x, {OVER_WHITE.format(c='r')} AS r, {OVER_WHITE.format(c='g')} AS g,
             {OVER_WHITE.format(c='b')} AS b FROM q),
e AS (SELECT sid, h, w, y, x, CASE WHEN least(r, g, b) > 245 OR greatest(r, g, b) < 10 THEN '~'
       ELSE chr(CAST(59 + floor(r / 64) * 16 + floor(g / 64) * 4 + floor(b / 64) AS INT)) END AS tok FROM c)
"""
GRID_TEXT = GRID + f""",
ln AS (SELECT sid, y, string_agg(tok, ' ' ORDER BY x) AS line FROM e GROUP BY sid, y),
gt AS (SELECT sid, string_agg(line, chr(10) ORDER BY y) AS data FROM ln GROUP BY sid),
nm AS ({SUPPLIER_NAMES}),
grids AS (SELECT nm.sid, generation, game_name, name, data FROM gt JOIN nm ON gt.sid = nm.sid)
"""
# trimmed cells `t`, kept sprites `fit`, and the padded 64 x 64 cells `f`
FITTED = GRID + """,
ky AS (SELECT sid, y, row_number() OVER (PARTITION BY sid ORDER BY y) - 1 AS ty
       FROM (SELECT DISTINCT sid, y FROM e WHERE tok <> '~')),
kx AS (SELECT sid, x, row_number() OVER (PARTITION BY sid ORDER BY x) - 1 AS tx
       FROM (SELECT DISTINCT sid, x FROM e WHERE tok <> '~')),
t AS (SELECT e.sid, ty, tx, tok FROM e JOIN ky ON e.sid = ky.sid AND e.y = ky.y
      JOIN kx ON e.sid = kx.sid AND e.x = kx.x),
dim AS (SELECT sid, max(ty) + 1 AS th, max(tx) + 1 AS tw FROM t GROUP BY sid),
fit AS (SELECT s.sid, coalesce(th, 1) AS th, coalesce(tw, 0) AS tw
        FROM s LEFT JOIN dim ON s.sid = dim.sid WHERE coalesce(th, 1) <= 64 AND coalesce(tw, 0) <= 64),
f AS (SELECT fit.sid, CAST(gy.y AS INT) AS y, CAST(gx.x AS INT) AS x, coalesce(t.tok, '~') AS tok
      FROM fit CROSS JOIN range(64) AS gy(y) CROSS JOIN range(64) AS gx(x)
      LEFT JOIN t ON t.sid = fit.sid AND t.ty = gy.y - (64 - th) // 2 AND t.tx = gx.x - (64 - tw) // 2)
"""
# the twelve variants of the fitted cells
VARIANTS = FITTED + f""",
v(label, suffix, pr, pg, pb) AS (VALUES (0, '', 0, 1, 2), (1, '_rg', 1, 0, 2), (2, '_rb', 2, 1, 0),
  (3, '_gb', 0, 2, 1), (4, '_cyc1', 1, 2, 0), (5, '_cyc2', 2, 0, 1)),
fl(flipped, fsuffix) AS (VALUES (0, ''), (1, '_flip')),
lv AS (SELECT sid, y, x, tok, [(ascii(tok) - 59) // 16, (ascii(tok) - 59) // 4 % 4, (ascii(tok) - 59) % 4] AS l FROM f),
nm AS ({SUPPLIER_NAMES}),
av AS (SELECT lv.sid, concat(replace(name, '.txt', ''), suffix, fsuffix, '.txt') AS name, generation, game_name,
        label AS color_shift, y, CASE WHEN flipped = 1 THEN 63 - x ELSE x END AS x,
        CASE WHEN tok = '~' THEN '~' ELSE chr(CAST(59 + l[pr + 1] * 16 + l[pg + 1] * 4 + l[pb + 1] AS INT)) END AS tok
       FROM lv CROSS JOIN v CROSS JOIN fl JOIN nm ON nm.sid = lv.sid)
"""


def from_sql(spark, sf, sql, table):
    """Run a shared SQL text over a test table."""
    return spark.sql(sql.replace("FROM " + table, "FROM {t}"), t=load(spark, sf, table))


SPRITES_PER_TASK = 512


def spread(rows, key="sid", per_task=SPRITES_PER_TASK):
    """Rows of which each makes thousands of pixels, over all cores and at most about `per_task` to a task: the small file they come
    from would be one task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, ceil(rows.count() / per_task)), key)


def sprite_bytes(sid, h, w):
    """The pixels of ALPHA, RED, GREEN and BLUE as bytes of B, G, R, A."""
    y, x = np.arange(h, dtype=np.int64)[:, None], np.arange(w, dtype=np.int64)[None, :]
    clear = (y < sid % 5) | (x < sid % 4) | (y >= h - 2) | (x >= w - 2) | (y % 13 == 0) | ((y * x + sid) % 7 < 3)
    alpha = np.where(clear, 0, np.where((x + y) % 11 == 0, 128, 255))
    if sid % 10 == 7:
        alpha = np.where((y == 5) & (x == 5), alpha, 0)
    if sid % 9 == 4:
        alpha[0, 0] = 255
    channels = np.broadcast_arrays(x * y + sid * 11, y * 7 + sid, x * 5 + sid * 3, alpha)
    return (np.stack(channels, axis=2) % 256).astype(np.uint8).tobytes()


def images(spark, sf):
    """Sprites as image rows with an alpha channel, from `supplier`."""

    @F.arrow_udf("binary")
    def draw(sid: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        return pa.array(map(sprite_bytes, sid.to_pylist(), h.to_pylist(), w.to_pylist()), pa.binary())

    return spread(from_sql(spark, sf, SPRITES, "supplier")).select(
        "sid", "generation", "game_name", F.replace("name", F.lit(".txt"), F.lit(".png")).alias("name"),
        F.col("h").alias("height"), F.col("w").alias("width"), F.lit(4).alias("n_channels"),
        apart(draw)(F.col("sid"), F.col("h"), F.col("w")).alias("data"),
    )


def pixels(spark, sf):
    """The same pixels, one row each."""
    sized = spread(from_sql(spark, sf, SPRITE_SIZES, "supplier"))
    rows = sized.withColumn("y", F.explode(F.expr("sequence(0, h - 1)"))).withColumn(
        "x", F.explode(F.expr("sequence(0, w - 1)"))
    )
    return rows.select(
        "sid", "y", "x",
        *[F.expr(e).cast("int").alias(c) for c, e in (("r", RED), ("g", GREEN), ("b", BLUE), ("a", ALPHA))],
    )


def grids(spark, sf):
    """Grids of the sprites with the names of their text files."""
    return encode_images(images(spark, sf)).withColumn("name", F.replace("name", F.lit(".png"), F.lit(".txt")))


def documents(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "text")


# documents as sequence texts with rows of 16, and their tokens with a 0-based position
DOC_LINES = r"""
dl AS (SELECT doc_id, l.i AS i, string_split_regex(trim(l.line, chr(32) || chr(9) || chr(13)), '\s+') AS w
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) AS l
       WHERE trim(l.line, chr(32) || chr(9) || chr(13)) <> ''),
dn AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS row, w FROM dl),
dr AS (SELECT doc_id, row, list_concat([printf('[ROW_%02d]', row)], list_slice(w, 2, 16)) AS toks FROM dn),
ds AS (SELECT doc_id, flatten(list(toks ORDER BY row)) AS toks FROM dr GROUP BY doc_id)
"""
DOC_TOKENS = DOC_LINES + r""",
dt AS (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos FROM ds),
dm AS (SELECT doc_id, pos, tok, CASE WHEN regexp_full_match(tok, '\[ROW_([0-5][0-9]|6[0-3])\]')
        THEN CAST(tok[6:7] AS INT) END AS m FROM dt)
"""
# (token, id) of the special tokens, and the vocabulary `vocab` of a table `corpus(tok)`
SPECIALS = """
sp AS (SELECT token, CAST(id AS INT) AS id FROM (VALUES ('[PAD]', 0), ('[BOS]', 1), ('[EOS]', 2), ('[UNK]', 3)) AS v(token, id)
       UNION ALL SELECT printf('[ROW_%02d]', i), CAST(4 + i AS INT) FROM range(64) AS r(i))
"""
VOCAB = SPECIALS + """,
vocab AS (SELECT token, id FROM sp UNION ALL
          SELECT tok, CAST(67 + row_number() OVER (ORDER BY tok) AS INT)
          FROM (SELECT DISTINCT tok FROM corpus WHERE tok NOT IN (SELECT token FROM sp)))
"""
BENCHMARK_VOCAB = r"""
corpus AS (SELECT tok FROM (SELECT unnest(string_split_regex(text, '\s+')) AS tok FROM benchmark) AS b WHERE tok <> ''),
""" + VOCAB
DOC_ROW_LENGTH = 16


def document_tokens(spark, sf):
    """Documents as sequence texts with their tokens."""
    texts = to_sequence(documents(spark, sf), "text", "seq", DOC_ROW_LENGTH)
    return texts.select("doc_id", "seq", words(F.col("seq")).alias("tokens"))


def benchmark_vocab(spark, sf):
    return build_vocab(load(spark, sf, "benchmark"))


def as_text(column):
    return F.array_join(F.col(column).cast("array<string>"), " ")


def wide_as_text(column):
    """`as_text` of arrays of thousands of numbers, on Arrow batches; for columns that hold no lambda functions."""

    @F.arrow_udf("string")
    def joined(lists: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        full = np.concatenate([[0], np.cumsum(flat.is_valid().to_numpy(zero_copy_only=False))])
        ends = full[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int32)
        texts = pa.ListArray.from_arrays(pa.array(ends), flat.drop_null().cast(pa.string()), mask=lists.is_null())
        return pc.binary_join(texts, " ")

    return apart(joined)(F.col(column))
