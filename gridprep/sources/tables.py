"""Keyed Parquet tables of grids and images, and point reads from them."""

from pyspark.errors import AnalysisException
from pyspark.sql import Window, functions as F

from gridprep.operators.joins import bounded_rows
from gridprep.session import ensure_checkpoint_dir

KEY = ["generation", "game_name", "name"]
PARTITION = KEY[:2]


def read_one(df, generation, game_name, name, suffix=".txt"):
    """The row with a key; a wrong suffix or a missing row is an error."""
    if not name.endswith(suffix):
        raise ValueError(f"{name} does not end in {suffix}")
    row = df.where(
        (F.col("generation") == generation) & (F.col("game_name") == game_name) & (F.col("name") == name)
    )
    if row.isEmpty():
        raise ValueError(f"nothing stored as {generation}/{game_name}/{name}")
    return row


def restrict(df, generation=None, game_name=None):
    """Rows of one generation, one game or both; on a stored table whole folders are skipped."""
    if generation is not None:
        df = df.where(F.col("generation") == generation)
    if game_name is not None:
        df = df.where(F.col("game_name") == game_name)
    return df


def last_per_key(df, key, order):
    """The last row of each key. Each task keeps one row per key before the shuffle."""
    newest = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def upsert(df, path, order=None):
    """Write rows into a table partitioned by generation and game; a row replaces the stored one
    with its key. Only folders that get rows are rewritten.

    `order` says which of several new rows with a key is the last; without it keys have to
    be unique.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    # read for its folders, for its keys and to be written; made once
    rows = (df if order is None else last_per_key(df, KEY, order)).checkpoint()
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        stored = None
    if stored is not None:
        kept = _in_folders(stored, rows).join(rows.select(*KEY), KEY, "left_anti")
        rows = rows.unionByName(kept, allowMissingColumns=True)
    # tasks of even size, each with few folders; a large folder is written by several tasks
    rows = rows.hint("rebalance", *PARTITION)
    rows.write.partitionBy(*PARTITION).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def _in_folders(stored, rows):
    """Stored rows in the folders that `rows` go to. A listed folder is skipped without a scan."""
    folders = rows.select(*PARTITION).distinct()
    listed = bounded_rows(folders)
    if listed is None:
        return stored.join(folders, PARTITION, "left_semi")
    wanted = F.lit(False)
    for generation in sorted({r["generation"] for r in listed}):
        games = [r["game_name"] for r in listed if r["generation"] == generation]
        wanted = wanted | ((F.col("generation") == generation) & F.col("game_name").isin(games))
    return stored.where(wanted)


def list_generations(df):
    return df.select("generation").distinct().orderBy("generation")


def generations_in_text(df, text, pattern=r"generation-(\d+)"):
    """Generation numbers found in lines of text, the first of each line, sorted."""
    line = F.explode(F.split(text, r"\r\n|\n|\r")).alias("line")
    found = df.select(line).select(F.regexp_extract("line", pattern, 1).alias("g")).where("g <> ''")
    return found.select(F.col("g").cast("int").alias("generation")).distinct().orderBy("generation")
