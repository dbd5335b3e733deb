"""Listing of file trees: root/generation/game/file."""

import re
from math import ceil

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F


TASKS_PER_CORE = 4
FILES_PER_TASK = 1024
TASK_BYTES = 16 << 20


def tree_files(spark, root, generation=None, game_name=None, suffix=".txt"):
    """(files, reader, path, tasks) of a tree or a part of it: the folder is listed by Spark, and only the wanted part.

    `files` are as the binary source has them; `reader` reads the path in another format. Spark gives a task 32 small files,
    however many there are; `tasks` of them, to which the files are to be coalesced, read up to FILES_PER_TASK or about
    TASK_BYTES each. No file, a file that stands higher or one that stands deeper is an error.
    """
    folder = str(root) if not generation and not game_name else f"{root}/{generation or '*'}/{game_name or '*'}"

    def reader():
        return spark.read.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true")

    try:
        files = reader().format("binaryFile").load(folder)
    except AnalysisException as error:
        raise ValueError(f"no files at {folder}") from error
    name = re.escape(re.sub("^[a-z0-9]+:/*", "/", str(root)).rstrip("/"))
    fits = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).rlike(f"{name}/[^/]+/[^/]+/[^/]+$")
    least = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    found = files.select("path", "length").coalesce(least).agg(
        F.count("*").alias("n"), F.sum("length").alias("bytes"), F.min(F.when(~fits, F.col("path"))).alias("odd")).head()
    if not found["n"]:
        raise ValueError(f"no files at {folder}")
    if found["odd"] is not None:
        raise ValueError(f"{found['odd']} is not in a folder of a generation and a game")
    return files, reader(), folder, max(least, ceil(found["n"] / FILES_PER_TASK), ceil(found["bytes"] / TASK_BYTES))


def list_files(spark, pattern):
    """(path, length) of the files; their content is not read."""
    try:
        return spark.read.format("binaryFile").load(pattern).select("path", "length")
    except AnalysisException as error:
        raise ValueError(f"no files at {pattern}") from error


def path_keys(path):
    """generation, game_name and name from the last three parts of a path."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return [
        F.regexp_extract(decoded, r"([^/]+)/([^/]+)/([^/]+)$", i + 1).alias(key)
        for i, key in enumerate(("generation", "game_name", "name"))
    ]
