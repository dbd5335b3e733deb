"""Samples in training logs."""

from pyspark.sql import Window, functions as F

from gridprep.constants import LOG_END, LOG_OPEN_HEADER, LOG_PATTERN
from gridprep.operators.joins import join_unique
from gridprep.session import stored

END = "\n" + LOG_END


def scan_log(spark, path):
    """Log files cut behind every end line, so that a large file is read by many tasks.

    Line breaks are folded to line feeds. What follows the last end line of a file gets none; the sizes tell
    whether there is such a rest. An end line that follows a header at once is not the end of that sample: the header
    and that line are put before the next piece, in which the sample ends.
    """
    cut = spark.read.option("lineSep", END).text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"),
    )
    # no text is sorted or kept for this: a few numbers for each block
    blocks = stored(cut.select(
        "file", "size", "block", "n", F.octet_length("value").alias("bytes"), F.col("value").rlike(LOG_OPEN_HEADER).alias("open")
    ).groupBy("file", "size", "block").agg(
        F.min("n").alias("first"), F.count("*").alias("pieces"), F.sum(F.col("bytes") + len(END)).alias("bytes"), F.bool_or("open").alias("open")
    ), "blocks")
    of_file = Window.partitionBy("file")
    ends = blocks.select(
        "file", "block", "first", (F.sum("pieces").over(of_file.orderBy("block")) - F.col("pieces")).alias("before"),
        (F.sum("pieces").over(of_file) - 1).alias("last"), (F.sum("bytes").over(of_file) > F.col("size")).alias("has_rest"),
    )
    at = F.col("before") + F.col("n") - F.col("first")
    is_rest = F.col("has_rest") & (at == F.col("last"))
    # a carriage return before the end line belongs to its line break
    text = F.when(is_rest, _folded(F.col("value"))).otherwise(
        F.concat(_folded(F.regexp_replace("value", r"\r\z", "")), F.lit(END))
    )
    pieces = join_unique(cut, ends, ["file", "block"], spread=["n"]).select("file", at.alias("at"), text.alias("text"), "value")
    if blocks.where("open").isEmpty():
        return pieces.select("text")
    joined = join_unique(pieces.drop("value"), _openers(pieces), ["file", "at"], "left")
    opened = F.concat("opener", F.lit(END), "text")
    return joined.select(F.when(F.col("opener").isNotNull(), opened).otherwise(F.col("text")).alias("text"))


def _openers(pieces):
    """(file, at, opener): the pieces before which a sample is open, with its header.

    A piece that ends in a header and an end line leaves the sample open or not, by whether one was open before it, and any other
    piece leaves none. Of pieces in a row each turns what is before it, unless it gives the same for both.
    """
    header = F.regexp_extract("value", LOG_OPEN_HEADER, 1)

    def leaves_open(text):
        return F.regexp_replace(text, LOG_PATTERN, "").endswith(F.concat("opener", F.lit(END)))

    before = F.concat(F.lit("=== Inference @ step 0 ===" + END), "text")
    found = stored(pieces.where(F.col("value").rlike(LOG_OPEN_HEADER) & F.col("text").endswith(LOG_END)).withColumn("opener", header).select(
        "file", "at", "opener", leaves_open(F.col("text")).alias("fresh"), leaves_open(before).alias("carried")
    ), "headers")
    order = Window.partitionBy("file").orderBy("at")
    is_new = F.coalesce(F.col("at") - F.lag("at").over(order) != 1, F.lit(True)) | (F.col("fresh") == F.col("carried"))
    runs = found.withColumn("new", is_new).withColumn("run", F.sum(F.col("new").cast("int")).over(order))
    run = Window.partitionBy("file", "run").orderBy("at")
    turns = F.sum((~F.col("new") & F.col("fresh")).cast("int")).over(run)
    state = (F.first("fresh").over(run).cast("int") + turns) % 2 == 1
    return runs.withColumn("state", state).where("state").select("file", (F.col("at") + 1).alias("at"), "opener")


def _folded(text):
    return F.regexp_replace(text, r"\r\n?", "\n")


def scrape_log(df, text="text"):
    """One row per sample block with its step and text."""
    kept = [c for c in df.columns if c != text]

    def group(i):
        return F.regexp_extract_all(text, F.lit(LOG_PATTERN), F.lit(i))

    blocks = F.arrays_zip(group(1).alias("step"), group(2).alias("sample"))
    return df.select(*kept, F.inline(blocks)).withColumn("step", F.col("step").cast("bigint"))
