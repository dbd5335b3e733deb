"""Pixels and grids."""

from pyspark.sql import functions as F

from gridprep.constants import PERMUTATIONS
from gridprep.functions import grids as G
from gridprep.functions.names import swap_extension, variant_name
from gridprep.functions.pixels import palette_token
from gridprep.operators.augment import augment, decode_palette
from gridprep.operators.images import composite, pixels_to_grids, to_tensor
from gridprep.operators.validate import fit_grid
from suite import fixtures as X


def alpha_composite(spark, sf):
    return composite(X.pixels(spark, sf))


def palette_encode(spark, sf):
    white = composite(X.pixels(spark, sf))
    return white.select("sid", "y", "x", palette_token(F.col("r"), F.col("g"), F.col("b")).alias("tok"))


def grid_from_pixels(spark, sf):
    white = composite(X.pixels(spark, sf))
    return pixels_to_grids(white, ["sid"], palette_token(F.col("r"), F.col("g"), F.col("b")))


def grid_text_roundtrip(spark, sf):
    cells = X.grids(spark, sf).withColumn("cells", G.text_to_grid(F.col("data")))
    return cells.select(
        "sid", F.size("cells").alias("n_rows"), F.size(F.get("cells", F.lit(0))).alias("n_cols"),
        G.grid_to_text(F.col("cells")).alias("data"),
    )


def palette_decode(spark, sf):
    return decode_palette(X.grids(spark, sf).select("sid", "data")).drop("token")


def trim_blank(spark, sf):
    return X.grids(spark, sf).select("sid", G.grid_to_text(G.trim_blank(G.grid_cells(F.col("data")))).alias("data"))


def pad_center(spark, sf):
    return fit_grid(X.grids(spark, sf)).select("sid", "data")


def flip(spark, sf):
    return X.grids(spark, sf).select("sid", G.flip_horizontal(F.col("data")).alias("data"))


def color_shift(spark, sf):
    return X.grids(spark, sf).select(
        "sid", *[G.permute_channels(F.col("data"), p).alias(suffix[1:]) for suffix, p in PERMUTATIONS]
    )


def augment_fanout(spark, sf):
    return augment(fit_grid(X.grids(spark, sf))).select(
        "sid", "name", "generation", "game_name", "color_shift", F.md5("data").alias("digest")
    )


def names(spark, sf):
    return X.from_sql(spark, sf, X.CUSTOMER_NAMES, "customer")


def variant_names(spark, sf):
    columns = [
        variant_name(F.col("name"), F.lit(suffix), F.lit(flipped)).alias(("p" + suffix) + ("_flip" if flipped else ""))
        for suffix in ["", *[s for s, _ in PERMUTATIONS]] for flipped in (False, True)
    ]
    return names(spark, sf).select("cid", *columns)


def swap_ext(spark, sf):
    there = names(spark, sf).withColumn("image_name", swap_extension(F.col("name"), ".txt", ".png"))
    return there.select("cid", "image_name", swap_extension(F.col("image_name")).alias("grid_name"))


def tensor_layout(spark, sf):
    rows = to_tensor(X.images(spark, sf)).select("sid", "height", "width", F.posexplode("tensor").alias("pos", "v"))
    plane, line = F.col("height") * F.col("width"), F.col("width")
    placed = rows.select(
        "sid",
        F.floor(F.col("pos") / plane).cast("int").alias("c"),
        F.floor(F.col("pos") % plane / line).cast("int").alias("y"),
        (F.col("pos") % line).alias("x"),
        F.round(F.col("v") * 255).cast("long").alias("level"),
    )
    return placed.groupBy("sid", "c", "y").agg(
        F.count("*").alias("n"), F.sum(F.col("level") * (F.col("x") + 1)).alias("weighted"), F.sum("level").alias("total")
    )


QUERIES = {
    "alpha_composite": alpha_composite,
    "palette_encode": palette_encode,
    "grid_from_pixels": grid_from_pixels,
    "grid_text_roundtrip": grid_text_roundtrip,
    "palette_decode": palette_decode,
    "trim_blank": trim_blank,
    "pad_center": pad_center,
    "flip": flip,
    "color_shift": color_shift,
    "augment_fanout": augment_fanout,
    "variant_names": variant_names,
    "swap_ext": swap_ext,
    "tensor_layout": tensor_layout,
}

LEVELS = "[(ascii(tok) - 59) // 16, (ascii(tok) - 59) // 4 % 4, (ascii(tok) - 59) % 4]"
SHIFTED = "CASE WHEN tok = '~' THEN '~' ELSE chr(CAST(59 + l[{0}] * 16 + l[{1}] * 4 + l[{2}] AS INT)) END"


def _shift_text(suffix, permutation):
    cell = SHIFTED.format(*[p + 1 for p in permutation])
    return f"string_agg({cell}, ' ' ORDER BY x) AS {suffix[1:]}"


ORACLES = {
    "alpha_composite": f"WITH {X.GRID} SELECT sid, y, x, r, g, b FROM c",
    "palette_encode": f"WITH {X.GRID} SELECT sid, y, x, tok FROM e",
    "grid_from_pixels": f"WITH {X.GRID_TEXT} SELECT sid, data FROM gt",
    "grid_text_roundtrip": f"""WITH {X.GRID_TEXT} SELECT s.sid, h AS n_rows, w AS n_cols, data FROM gt JOIN s ON s.sid = gt.sid""",
    "palette_decode": f"""WITH {X.GRID} SELECT sid, y, x,
        CAST(CASE WHEN tok = '~' THEN 255 ELSE (ascii(tok) - 59) // 16 * 64 + 32 END AS INT) AS r,
        CAST(CASE WHEN tok = '~' THEN 255 ELSE (ascii(tok) - 59) // 4 % 4 * 64 + 32 END AS INT) AS g,
        CAST(CASE WHEN tok = '~' THEN 255 ELSE (ascii(tok) - 59) % 4 * 64 + 32 END AS INT) AS b FROM e""",
    "trim_blank": f"""WITH {X.FITTED},
        ln AS (SELECT sid, ty, string_agg(tok, ' ' ORDER BY tx) AS line FROM t GROUP BY sid, ty),
        gt AS (SELECT sid, string_agg(line, chr(10) ORDER BY ty) AS data FROM ln GROUP BY sid)
        SELECT s.sid, coalesce(data, '') AS data FROM s LEFT JOIN gt ON s.sid = gt.sid""",
    "pad_center": f"""WITH {X.FITTED},
        ln AS (SELECT sid, y, string_agg(tok, ' ' ORDER BY x) AS line FROM f GROUP BY sid, y)
        SELECT sid, string_agg(line, chr(10) ORDER BY y) AS data FROM ln GROUP BY sid""",
    "flip": f"""WITH {X.GRID},
        ln AS (SELECT sid, y, string_agg(tok, ' ' ORDER BY x DESC) AS line FROM e GROUP BY sid, y)
        SELECT sid, string_agg(line, chr(10) ORDER BY y) AS data FROM ln GROUP BY sid""",
    "color_shift": f"""WITH {X.GRID}, lv AS (SELECT sid, y, x, tok, {LEVELS} AS l FROM e),
        ln AS (SELECT sid, y, {', '.join(_shift_text(*p) for p in PERMUTATIONS)} FROM lv GROUP BY sid, y)
        SELECT sid, {', '.join(f"string_agg({s[1:]}, chr(10) ORDER BY y) AS {s[1:]}" for s, _ in PERMUTATIONS)}
        FROM ln GROUP BY sid""",
    "augment_fanout": f"""WITH {X.VARIANTS},
        ln AS (SELECT sid, name, generation, game_name, color_shift, y, string_agg(tok, ' ' ORDER BY x) AS line
               FROM av GROUP BY ALL)
        SELECT sid, name, generation, game_name, CAST(color_shift AS INT) AS color_shift,
          md5(string_agg(line, chr(10) ORDER BY y)) AS digest FROM ln GROUP BY ALL""",
    "variant_names": f"""WITH n AS ({X.CUSTOMER_NAMES}), b AS (SELECT cid, replace(name, '.txt', '') AS b FROM n)
        SELECT cid, """ + ", ".join(
        f"concat(b, '{s}{'_flip' if f else ''}.txt') AS p{s}{'_flip' if f else ''}"
        for s in ["", "_rg", "_rb", "_gb", "_cyc1", "_cyc2"] for f in (False, True)
    ) + " FROM b",
    "swap_ext": f"""WITH n AS ({X.CUSTOMER_NAMES}) SELECT cid, replace(name, '.txt', '.png') AS image_name, name AS grid_name FROM n""",
    "tensor_layout": f"""WITH {X.PX}, u AS (SELECT sid, y, x, unnest([r, g, b]) AS level, unnest([0, 1, 2]) AS c FROM q)
        SELECT sid, CAST(c AS INT) AS c, y, count(*) AS n, CAST(sum(level * (x + 1)) AS BIGINT) AS weighted,
          CAST(sum(level) AS BIGINT) AS total FROM u GROUP BY sid, c, y""",
}
