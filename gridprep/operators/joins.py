"""Joins with lookup tables, by size."""

from pyspark.sql import functions as F, types as T

from gridprep.constants import MAX_BROADCAST_ROWS


def bounded_rows(df, limit=MAX_BROADCAST_ROWS):
    """The rows if there are at most `limit`, else None. No more than limit + 1 are fetched."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


MAX_BROADCAST_BYTES = 32 << 20


def is_small(df, limit=MAX_BROADCAST_ROWS, most_bytes=MAX_BROADCAST_BYTES):
    """Whether a table has at most `limit` rows and, as measured, at most `most_bytes` bytes."""
    rows, size = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(_row_bytes(df.schema)), F.lit(0))).head()
    return rows <= limit and size <= most_bytes


def _row_bytes(schema):
    """The bytes of a row, about: texts and arrays by their length, nested values by their length as JSON."""
    fixed = T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType

    def width(field):
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.octet_length(column)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, fixed):
            return F.size(column) * 8
        if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            return F.octet_length(F.to_json(F.struct(column)))
        return F.lit(8)

    return sum((F.greatest(F.coalesce(width(f), F.lit(0)), F.lit(8)).cast("long") for f in schema.fields), F.lit(0).cast("long"))


def broadcast_if_small(df, limit=MAX_BROADCAST_ROWS):
    """Mark a table of at most `limit` rows and MAX_BROADCAST_BYTES bytes for broadcast; leave a larger one to a shuffle."""
    return F.broadcast(df) if is_small(df, limit) else df


ROWS_PER_TASK = 1_000_000


def join_unique(df, table, on, how="inner", spread=None, limit=MAX_BROADCAST_ROWS, rows_per_task=ROWS_PER_TASK, most_bytes=MAX_BROADCAST_BYTES):
    """Join a table with one row per key.

    A table of few rows and bytes is sent to all tasks and `df` does not move. A larger one is joined by shuffle, and the
    rows of frequent keys are spread as `spread_join` does, by a hash of the `spread` columns, which should tell rows
    of a key apart.
    """
    if is_small(table, limit, most_bytes):
        return df.join(F.broadcast(table), on, how)
    return _spread(df, table, list(on), how, spread, rows_per_task)


def spread_join(df, table, key, how="inner", spread=None, rows_per_task=ROWS_PER_TASK):
    """Join on one key column of which single values may hold a large share of `df`.

    Keys with more than `rows_per_task` rows are cut into that many parts by a hash of the `spread` columns, and only their rows of
    `table` are copied, once for each part. All other keys join as they are. `table` may hold several rows per key.
    """
    return _spread(df, table, [key], how, spread, rows_per_task)


def _spread(df, table, on, how, spread, rows_per_task):
    hot = _hot_keys(df, on, rows_per_task)
    if hot is None:
        return df.join(table, on, how)
    spread = spread or [c for c in df.columns if c not in on] or on
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int"), F.lit(0))
    left = df.join(hot, on, "left").withColumn("_salt", salt).drop("_parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    right = table.join(hot, on, "left").withColumn("_salt", copies).drop("_parts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def _hot_keys(df, on, rows_per_task, most=MAX_BROADCAST_ROWS):
    """The keys with more than `rows_per_task` rows and how many parts each needs, marked for broadcast; None without any.

    If more than `most` keys are that frequent, those with more than their rows / `most` are taken: there are fewer than
    `most` of them, and every other key fits a task as well as they do."""
    counts = df.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > rows_per_task)
    n, rows = counts.agg(F.count("*"), F.sum("_n")).head()
    if n == 0:
        return None
    each = max(rows_per_task, -(-rows // most)) if n > most else rows_per_task
    return F.broadcast(counts.where(F.col("_n") > each).select(*on, F.ceil(F.col("_n") / each).cast("int").alias("_parts")))
