"""Fan-out of grids into colour and mirror variants."""

from pyspark.sql import functions as F

from gridprep.functions.grids import flip_horizontal, permute_channels_by
from gridprep.functions.names import variant_name, variants
from gridprep.functions.pixels import palette_level
from gridprep.functions.text import lines


def augment(df, permutations=None, name="name", data="data"):
    """One row per variant, with its name and `color_shift` label.

    The mirror image is made once per grid; each variant then recodes characters.
    """
    listed = variants(permutations)
    shifts = {label: permutation for label, _, _, permutation in listed}
    choices = F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(suffix).alias("suffix"), F.lit(flipped).alias("flipped"))
        for label, suffix, flipped, _ in listed
    ])
    spread = df.withColumn("_flip", flip_horizontal(F.col(data))).withColumn("_v", F.explode(choices))
    base = F.when(F.col("_v.flipped"), F.col("_flip")).otherwise(F.col(data))
    return spread.withColumns({
        name: variant_name(F.col(name), F.col("_v.suffix"), F.col("_v.flipped")),
        data: permute_channels_by(base, F.col("_v.label"), shifts),
        "color_shift": F.col("_v.label"),
    }).drop("_v", "_flip")


def decode_palette(df, data="data"):
    """One row per cell with the centre colour of its token."""
    rows = df.select(*[c for c in df.columns if c != data], F.posexplode(lines(F.col(data))).alias("y", "_line"))
    kept = [c for c in rows.columns if c != "_line"]
    cells = rows.select(*kept, F.posexplode(F.split("_line", " ")).alias("x", "token"))
    return cells.withColumns({c: palette_level(F.col("token"), c) for c in ("r", "g", "b")})
