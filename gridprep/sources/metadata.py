"""Species metadata files."""

from pyspark.sql import functions as F, types as T

from gridprep import schemas
from gridprep.operators.keys import keyed_last


def read_metadata(spark, path):
    """Rows of JSON arrays of species; of several with an id the last one counts. A file that is no such array,
    or is cut off, is an error."""
    parsed = F.from_json("value", T.ArrayType(schemas.METADATA), {"mode": "FAILFAST"})
    bad = F.raise_error(F.concat(F.lit("no list of species in "), F.col("_metadata.file_path")))
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("_file"),
        F.posexplode(F.coalesce(parsed, bad.cast(T.ArrayType(schemas.METADATA)))).alias("_pos", "s"),
    )
    return keyed_last(files.select("_file", "_pos", "s.*"), ["id"], ["_file", "_pos"]).drop("_file", "_pos")
