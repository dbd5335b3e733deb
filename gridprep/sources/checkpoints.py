"""Training checkpoints in a file listing."""

from pyspark.sql import functions as F

from gridprep.sources.files import list_files

STATE_FILE = "trainer_state.json"


def latest_valid(listing, group=(), state_file=STATE_FILE):
    """Highest step whose state file is there and not empty, with its folder; null if none is.

    `listing` holds (path, length) of files in folders named checkpoint-<step>.
    """
    folder = F.regexp_extract("path", r"^(.*/checkpoint-\d+[^/]*)/[^/]*$", 1)
    step = F.regexp_extract(folder, r"checkpoint-(\d+)[^/]*$", 1).try_cast("bigint")
    is_state = F.regexp_extract("path", r"([^/]+)$", 1) == state_file
    valid = F.when(is_state & (F.col("length") > 0), step)
    return listing.groupBy(*group).agg(
        F.max(valid).alias("step"), F.max_by(folder, valid).alias("checkpoint")
    )


def latest_checkpoint(spark, root, state_file=STATE_FILE):
    return latest_valid(list_files(spark, f"{root}/checkpoint-*/*"), state_file=state_file)
