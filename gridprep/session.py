"""Session defaults and the checkpoint folder."""

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app_name="gridprep", master=None, **conf):
    """A session with the settings the operators are tuned for; `conf` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark):
    """Use the shared folder the cluster names. Only a session whose driver is its one executor may do without:
    it then gets a scratch folder, which it cleans with the session."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="gridprep-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(shared)


def shared_folder(spark, purpose):
    """A fresh folder name under the checkpoint folder that the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{purpose}-{uuid.uuid4().hex}"


def stored(df, purpose="table"):
    """The table as files in the shared folder: later steps read them, and a lost executor takes nothing with it."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
TEXT_BATCH_BYTES = 4 << 20


def bound_batches(spark):
    """Whole texts go to Python in batches of about TEXT_BATCH_BYTES, unless the session sets another size: of 10,000 rows
    or 64 MB, as Spark has it, each task holds several in its executor and in its worker at once."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(TEXT_BATCH_BYTES))


def shuffle_partitions(spark):
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
