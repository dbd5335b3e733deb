"""Tokenised texts as rows: chunks, states, checks."""

from pyspark.sql import functions as F

from gridprep.constants import CONTEXT_LENGTH, PAD_ID, ROW_LENGTH
from gridprep.functions import tokens as T
from gridprep.functions.text import let, running_sum, with_kept, words


def to_sequence(df, data="data", text="text", row_length=ROW_LENGTH):
    """Add the sequence text of a grid; grids without data are left out."""
    # a filter is not pushed below a Python function that stands apart
    return df.withColumn(text, F.when(F.col(data) != "", T.sequence_text(F.col(data), row_length))).where(F.col(text).isNotNull())


def to_sequence_bos(df, data="data", text="text", row_length=ROW_LENGTH):
    form = T.sequence_text_bos(F.col(data), row_length)
    return with_kept(df, text, F.when(F.col(data) != "", form), lambda t: t.isNotNull())


def chunk_pad(df, ids="input_ids", length=CONTEXT_LENGTH):
    """Disjoint chunks of `length` ids with labels, mask and positions; the last is filled up.

    A row without ids gives one chunk of padding.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size(ids), F.lit(1)) - 1, F.lit(length))
    cut = df.withColumn("_start", F.explode(starts))
    cut = cut.withColumn("_n", F.least(F.size(ids) - F.col("_start"), F.lit(length)))
    start, n = F.col("_start"), F.col("_n")
    filled = F.concat(
        F.slice(ids, start + 1, F.lit(length)), F.array_repeat(F.lit(PAD_ID), F.lit(length) - n)
    )
    mask = F.concat(
        F.array_repeat(F.lit(1).cast("tinyint"), n),
        F.array_repeat(F.lit(0).cast("tinyint"), F.lit(length) - n),
    )
    return cut.withColumns({
        "chunk": (F.floor(start / length) + 1).cast("bigint"),
        ids: filled,
        "labels": filled,
        "attention_mask": mask,
        "row_ids": T.position_ids(T.row_pattern(), start, n, length),
        "col_ids": T.position_ids(T.col_pattern(), start, n, length),
    }).drop("_start", "_n")


def sliding_chunks(df, tokens="tokens", length=512, step=ROW_LENGTH, out="window"):
    """Overlapping windows of `length` tokens every `step`; texts that are too short give none."""
    last = F.size(tokens) - length
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step)))
    cut = df.withColumn("_start", F.explode(starts))
    return cut.withColumns({
        "chunk": (F.floor(F.col("_start") / step) + 1).cast("bigint"),
        out: F.slice(tokens, F.col("_start") + 1, F.lit(length)),
    }).drop("_start")


def length_stats(df, text="text", length=CONTEXT_LENGTH):
    """Tokens per sequence: least, most, mean, and the share that fits the context."""
    n = F.size(words(F.col(text)))
    return df.select(n.alias("n")).agg(
        F.min("n").alias("min_tokens"),
        F.max("n").alias("max_tokens"),
        F.avg("n").alias("mean_tokens"),
        F.avg(F.when(F.col("n") <= length, 1.0).otherwise(0.0)).alias("fit_share"),
    )


def check_sequence(df, tokens="tokens"):
    return df.withColumn("consistent", T.sequence_is_consistent(F.col(tokens)))


def row_state(df, tokens="tokens"):
    """Add `rows` and `used`: after each token the current row (-1 before the first marker)
    and the characters filled in it."""
    marks = F.transform(tokens, lambda t: F.coalesce(T.token_row(t), F.lit(-1)))
    lengths = F.transform(tokens, T.token_length)
    summed = df.withColumns({"_total": running_sum(lengths), "_marks": marks})
    # the total at the last marker, which is what the row started from
    bases = T._by_segment(
        F.arrays_zip(F.col("_marks").alias("row"), F.col("_total").alias("total")),
        lambda s: F.when(s["row"] >= 0, s["total"]),
        lambda n: F.array_repeat(F.lit(0).cast("bigint"), n),
        lambda base, n, start: F.array_repeat(base, n),
    )
    current = T._by_segment(
        F.col("_marks"),
        lambda row: F.when(row >= 0, row),
        lambda n: F.array_repeat(F.lit(-1), n),
        lambda row, n, start: F.array_repeat(row, n),
    )
    return summed.withColumns({
        "rows": current,
        "used": F.zip_with("_total", bases, lambda total, base: total - base),
    }).drop("_total", "_marks")


def row_report(df, tokens="tokens", width=ROW_LENGTH - 1):
    """One row per marker with the characters filled, and whether it is full and in order."""

    def segments(seq):
        marked = F.transform(seq, lambda t, i: F.struct(i.alias("at"), T.token_row(t).alias("row")))

        def reports(marks):
            return F.transform(
                marks,
                lambda m, k: F.struct(
                    k.alias("segment"),
                    m["row"].alias("row"),
                    F.coalesce(F.get(marks, k - 1)["row"], F.lit(-1)).alias("previous"),
                    F.aggregate(
                        F.slice(
                            seq, m["at"] + 2,
                            F.coalesce(F.get(marks, k + 1)["at"], F.size(seq)) - m["at"] - 1,
                        ),
                        F.lit(0),
                        lambda total, t: total + T.token_length(t),
                    ).alias("used"),
                ),
            )

        return let(F.filter(marked, lambda m: m["row"].isNotNull()), reports)

    kept = [c for c in df.columns if c != tokens]
    return (
        df.select(*kept, F.inline(let(F.col(tokens), segments)))
        .withColumn("full", F.col("used") == width)
        .withColumn("in_order", F.col("row") == F.col("previous") + 1)
        .drop("previous")
    )
