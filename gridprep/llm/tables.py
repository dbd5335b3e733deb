"""Reading inputs and cutting lineage."""

import uuid

from pyspark.sql import functions as F

from gridprep.session import BATCH_BYTES, TEXT_BATCH_BYTES, bound_batches, ensure_checkpoint_dir  # noqa: F401


def load(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark, purpose):
    """A fresh folder under the checkpoint folder that the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{purpose}-{uuid.uuid4().hex}"


def written(df, purpose="table"):
    """The table as files in the shared folder: later steps read it again instead of making it
    again, and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column="text"):
    """The text, or an empty one for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(doc_id, folds):
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))
