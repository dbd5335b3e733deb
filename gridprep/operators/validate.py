"""Filters over grid and image tables."""

from pyspark.sql import functions as F

from gridprep.constants import DOMINANCE_THRESHOLD, GENERATIONS, GRID_SIZE
from gridprep.functions import grids
from gridprep.functions.text import rows_where, with_kept, words


def select_generations(df, generations, known=GENERATIONS):
    """Rows of the generations asked for; a generation that is not known is an error."""
    unknown = [g for g in generations if g not in known]
    if unknown:
        raise ValueError(f"unknown generations {unknown}, known are {known}")
    return df.where(F.col("generation").isin(*generations))


def check_rectangular(df, data="data", on_error="raise"):
    """Every row of a grid has as many cells as its first row.

    `on_error`: "raise" stops the job and names the row, "drop" keeps the good grids,
    "flag" adds `ragged_row`, the index of the first bad row or null.
    """
    flagged = df.withColumn("ragged_row", grids.first_ragged_row(F.col(data)))
    if on_error == "flag":
        return flagged
    if on_error == "drop":
        return flagged.where("ragged_row IS NULL").drop("ragged_row")
    if on_error != "raise":
        raise ValueError(f"on_error is {on_error!r}")
    message = F.concat(
        F.lit("row "), F.col("ragged_row"), F.lit(" has another number of cells than row 0")
    )
    checked = F.when(F.col("ragged_row").isNull(), F.col(data)).otherwise(F.raise_error(message))
    return flagged.withColumn(data, checked).drop("ragged_row")


def non_empty(df, data="data"):
    return df.where(F.col(data) != "")


def filter_border(df, data="data"):
    return rows_where(df, F.col(data), lambda d: grids.border_is_blank(grids.grid_cells(d)))


def filter_dominant(df, data="data", threshold=DOMINANCE_THRESHOLD):
    return rows_where(df, F.col(data), lambda d: ~grids.is_dominated(words(d), threshold))


def fit_grid(df, data="data", size=GRID_SIZE):
    """Trim, drop what is larger than size × size, pad the rest to it."""
    trimmed = with_kept(
        df, "_cells", grids.trim_blank(grids.grid_cells(F.col(data))), lambda cells: grids.fits(cells, size)
    )
    return trimmed.withColumn(data, grids.pad_center(F.col("_cells"), size)).drop("_cells")


def filter_oversize(df, data="data", size=GRID_SIZE):
    """Grids that fit size × size once trimmed, as they are."""
    return rows_where(df, F.col(data), lambda d: grids.fits(grids.trim_blank(grids.grid_cells(d)), size))


def filter_exact(images, size=GRID_SIZE):
    """Readable images of exactly size × size."""
    return images.where((F.col("height") == size) & (F.col("width") == size) & F.col("data").isNotNull())
