"""Grid text files and stored grids."""

from pyspark.sql import functions as F

from gridprep.sources.files import path_keys, tree_files
from gridprep.sources.tables import restrict


def scan_grids(spark, root, generation=None, game_name=None, stored="text"):
    """Grids of a tree of text files, or of a Parquet table written with `upsert`."""
    if stored == "parquet":
        return restrict(spark.read.parquet(str(root)), generation, game_name)
    files, _, _, tasks = tree_files(spark, root, generation, game_name, ".txt")
    # the bytes as they are, as the text source has them too; that one opens a file several times slower
    text = F.regexp_replace(F.col("content").cast("string"), r"\r\n?", "\n").alias("data")
    return files.select("_metadata.file_path", "content").coalesce(tasks).select(*path_keys(F.col("file_path")), text)
