"""URL filter lists that change over time, as of the time each page was fetched.

A list is a history of dated entries. The entries of a pattern become intervals: each is in force from its
time until the pattern's next entry, and a removal leaves none. A capture is looked up under every
suffix of its host, with and without its first path segment, and every interval that holds its
fetch time applies; of those the most specific pattern decides.

The as-of join sorts lookups and intervals together and carries the last interval forward, so a lookup meets one
interval however long the history of its pattern is, and a pattern that most captures share is cut by time.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window, functions as F, types as T

from gridprep.llm.tables import written


def host_of(url):
    """The host of a URL in lower case, without user, port and final dot; empty if there is none."""
    authority = F.regexp_extract(F.lower(F.coalesce(url.cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""), r"\.$", "")


def segment_of(url):
    """The first path segment of a URL, empty if there is none."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)


def intervals(entries):
    """Validity intervals (pattern, verdict, since, until) from entries (pattern, dated, entry_id, action, verdict).

    `action` is add or remove; `until` is exclusive, null for ever. Of a pattern's entries at one time the
    one with the largest entry_id counts. Entries with a null pattern or time are never in force.
    """
    usable = entries.where("pattern IS NOT NULL AND dated IS NOT NULL")
    last = usable.groupBy("pattern", "dated").agg(F.max_by(F.struct("action", "verdict"), F.struct(F.col("entry_id"), F.col("action"), F.col("verdict"))).alias("e"))
    until = F.lead("dated").over(Window.partitionBy("pattern").orderBy("dated"))
    return last.withColumn("until", until).where("e.action = 'add'").select("pattern", F.col("e.verdict").alias("verdict"), F.col("dated").alias("since"), "until")


def _patterns(host, segment):
    """Every suffix of the host, alone and with the segment."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    with_segment = F.transform(suffixes, lambda s: F.concat(s, F.lit("/"), segment))
    every = F.when(segment == "", suffixes).otherwise(F.concat(suffixes, with_segment))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(every)


def _carried(batches):
    """Of sorted batches of lookups and intervals each lookup with the last interval before it, null if the part
    has none yet, and after them a row without a capture that holds the part's last interval."""
    part, last, schema = TaskContext.get().partitionId(), None, None
    for batch in batches:
        schema = batch.schema
        spans = batch.column("span")
        last = pa.nulls(1, spans.type) if last is None else last
        is_span = spans.is_valid().to_numpy(zero_copy_only=False)
        # place 0 is the interval carried into the batch
        at = np.maximum.accumulate(np.where(is_span, np.arange(1, len(is_span) + 1), 0))
        carried = pa.concat_arrays([last, spans]).take(pa.array(at))
        last = carried.slice(len(carried) - 1, 1) if len(carried) else last
        lookups = pa.array(~is_span)
        columns = [batch.column(c).filter(lookups) for c in ("capture", "pattern", "at")] + [carried.filter(lookups)]
        yield _with_part(part, columns)
    if schema is not None:
        yield _with_part(part, [pa.nulls(1, schema.field(c).type) for c in ("capture", "pattern", "at")] + [last])


def _with_part(part, columns):
    parts = pa.array(np.full(len(columns[0]), part, dtype=np.int32))
    return pa.RecordBatch.from_arrays([parts, *columns], names=["part", "capture", "pattern", "at", "span"])


def as_of(lookups, spans):
    """Each lookup (capture, pattern, at) that an interval of `intervals` holds, with it as `span`: at most one row for each.

    Intervals of a pattern do not overlap, so only the last that begins at or before `at` can hold it. Rows are sorted by pattern
    and time over all parts; the interval carried into a part is the last one of the parts before it.
    """
    span = F.struct("pattern", "verdict", "since", "until")
    both = lookups.select("capture", "pattern", "at", F.lit(None).cast(spans.select(span.alias("s")).schema["s"].dataType).alias("span")).unionByName(
        spans.select(F.lit(None).cast("bigint").alias("capture"), "pattern", F.col("since").alias("at"), span.alias("span"))
    )
    # an interval stands before the lookups of its first moment
    order = ["pattern", "at", F.col("span").isNull(), "capture"]
    ordered = both.repartitionByRange(*order).sortWithinPartitions(*order)
    nullable = [T.StructField(f.name, f.dataType) for f in both.schema.fields]
    found = ordered.mapInArrow(_carried, T.StructType([T.StructField("part", T.IntegerType()), *nullable]))
    holds = (F.col("span.pattern") == F.col("pattern")) & (F.col("at") >= F.col("span.since")) & (F.col("span.until").isNull() | (F.col("at") < F.col("span.until")))
    found = written(found.where(F.col("capture").isNull() | F.col("span").isNull() | holds), "as_of")
    # one row for each part of the sort
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = found.where("capture IS NULL").select("part", F.last("span", ignorenulls=True).over(before).alias("before"))
    return found.where("capture IS NOT NULL").join(F.broadcast(ends), "part").withColumn("span", F.coalesce("span", "before")).where(holds).drop("part", "before")


def filter_captures(captures, entries):
    """One row per capture: page_id, host, fetched_at, verdict, pattern, since, n_active.

    `captures` has (page_id, url, fetched_at). `verdict` is that of the most specific pattern in force at
    the fetch time (the longest; of equally long ones the first in the alphabet), `none` if there is no
    such pattern, the URL is null or has no host, or the fetch time is null. `n_active` counts all patterns in
    force. Repeated captures each get a row; other columns are ignored.
    """
    url = F.col("url").cast("string")
    rows = written(
        captures.select(F.monotonically_increasing_id().alias("capture"), "page_id", host_of(url).alias("host"), segment_of(url).alias("segment"), "fetched_at"),
        "captures",
    )
    keys = rows.where("fetched_at IS NOT NULL").select(
        "capture", F.explode(_patterns(F.col("host"), F.col("segment"))).alias("pattern"), F.col("fetched_at").alias("at")
    )
    found = as_of(keys, intervals(entries)).select("capture", "span.*")
    # the first in the alphabet of the longest: by length, then by the fewest larger signs
    order = F.struct((-F.length("pattern")).alias("l"), F.col("pattern").alias("p"))
    decided = found.groupBy("capture").agg(F.min_by(F.struct("verdict", "pattern", "since"), order).alias("d"), F.count("*").alias("n"))
    return rows.join(decided, "capture", "left").select(
        "page_id", "host", "fetched_at", F.coalesce("d.verdict", F.lit("none")).alias("verdict"), F.col("d.pattern").alias("pattern"),
        F.col("d.since").alias("since"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_active"),
    )
