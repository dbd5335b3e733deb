"""Dataset versions: a training table and its vocabulary under root/box-<partition>."""

from pyspark.sql import functions as F

from gridprep.sources.files import list_files

VERSION_PREFIX = "box-"


def save_version(train, vocab, root, partition="latest"):
    name = f"{VERSION_PREFIX}{partition}"
    train.write.mode("overwrite").parquet(f"{root}/{name}/train")
    vocab.write.mode("overwrite").parquet(f"{root}/{name}/vocab")
    return name


def load_version(spark, root, partition=None):
    """(name, train, vocab) of a version, without a partition of the greatest name."""
    if partition:
        name = f"{VERSION_PREFIX}{partition}"
    else:
        files = list_files(spark, f"{root}/{VERSION_PREFIX}*/vocab/*.parquet")
        version = F.regexp_extract("path", rf"/({VERSION_PREFIX}[^/]*)/vocab/[^/]*$", 1)
        name = files.agg(F.max(version).alias("name")).first()["name"]
    return name, spark.read.parquet(f"{root}/{name}/train"), spark.read.parquet(f"{root}/{name}/vocab")


def latest_rows(df, version="version"):
    """Rows of the greatest version."""
    return df.where(F.col(version) == df.agg(F.max(version)).scalar())
