"""Positions in a global order without a single-task sort."""

from math import ceil, sqrt

from pyspark.sql import Window, functions as F

from gridprep.functions.text import let
from gridprep.session import ensure_checkpoint_dir, shuffle_partitions

OVERSAMPLE = 8
ROWS_PER_PART = 4_000_000


def _split_points(df, order, n):
    """`n - 1` keys that cut the table into about equal parts, from the keys with the smallest
    hashes. At most OVERSAMPLE * n keys are fetched. The sample only balances the parts; the
    ranks do not depend on it."""
    keys = df.select(*order)
    sample = keys.orderBy(F.xxhash64(*order), *order).limit(OVERSAMPLE * n)
    every = sample.orderBy(*order).collect()
    return [
        F.struct(*[F.lit(value).cast(df.schema[c].dataType).alias(c) for c, value in zip(order, row)])
        for row in every[OVERSAMPLE - 1::OVERSAMPLE][: n - 1]
    ]


def _part_of(key, points):
    """Number of points up to the key, looked up in two steps of about sqrt(n) comparisons."""
    if not points:
        return F.lit(0)
    width = ceil(sqrt(len(points)))
    coarse = points[width - 1::width]
    fine = F.array(*points)

    def locate(k):
        steps = F.size(F.filter(F.array(*coarse), lambda p: p <= k)) if coarse else F.lit(0)
        return let(
            steps * width,
            lambda c: c + F.size(F.filter(F.slice(fine, c + 1, F.lit(width)), lambda p: p <= k)),
        )

    return let(key, locate)


def global_rank(keys, order, out="rank", parts=None):
    """Add the 0-based position of each row in the order of the `order` columns.

    `keys` is a table of little more than the order columns, which together have to be unique;
    it is read several times, so it is checkpointed first. Rows go to parts by comparing them with
    split points over the whole key, so no value can make one part hot; each part is
    sorted by itself and starts at the sum of the sizes before it. There are as many parts as the session
    has shuffle partitions, or more, so that none has many more than ROWS_PER_PART rows.
    """
    spark = keys.sparkSession
    ensure_checkpoint_dir(spark)
    keys = keys.checkpoint()
    parts = parts or max(shuffle_partitions(spark), ceil(keys.count() / ROWS_PER_PART))
    points = _split_points(keys, order, parts)
    located = keys.withColumn("_part", _part_of(F.struct(*order), points))
    sizes = located.groupBy("_part").count()
    starts = sizes.select(
        "_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_start")
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (
        located.withColumn("_inside", inside)
        .join(F.broadcast(starts), "_part")
        .withColumn(out, F.col("_start") + F.col("_inside"))
        .drop("_part", "_start", "_inside")
    )
