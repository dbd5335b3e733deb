"""Building blocks shared by the other column functions."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from gridprep.constants import LINE_BREAK, LINE_BREAKS, OTHER_SPACES


def let(value, body):
    """Evaluate `value` once and hand it to `body`.

    A lambda that mentions an outer expression evaluates it for every element, and the
    optimizer may inline a projected column into such a lambda. A lambda variable is
    bound once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blanks_for(text, spaces):
    """The text with blanks for other whitespace; recoding every text is quicker than searching it."""
    return F.translate(text, spaces, " " * len(spaces))


def _at_blanks(text):
    """Words between blanks, which needs no pattern matching."""
    return F.array_remove(F.split(text, " "), "")


def words(text):
    """Like `text.split()`."""
    return _at_blanks(_blanks_for(text, OTHER_SPACES))


def line_words(text):
    """Like `[line.split() for line in text.split("\\n")]`."""
    return F.transform(lines(blanks_in_lines(text)), _at_blanks)


def blanks_in_lines(text):
    """The text with no whitespace but blanks and line feeds."""
    return _blanks_for(text, OTHER_SPACES.replace("\n", ""))


def lines(text):
    """Like `text.split("\\n")`."""
    return F.split(text, "\n")


def split_line_words(text):
    """Like `[line.split() for line in text.splitlines()]`: a final line break starts no new line."""
    spaces = "".join(c for c in OTHER_SPACES if c not in LINE_BREAKS)
    return let(
        F.split(_blanks_for(text, spaces), LINE_BREAK),
        lambda parts: F.transform(
            F.when(
                F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
            ).otherwise(parts),
            _at_blanks,
        ),
    )


def apart(function):
    """A Python function the optimizer neither repeats in a pushed-down filter nor nests into
    other expressions."""
    return function.asNondeterministic()


def with_kept(df, out, value, accept):
    """Add `value` as `out` and keep the rows whose value `accept` holds for, computing it once.

    A filter on a computed column is pushed below it and computes it again; one on the
    elements of a generator is not.
    """
    return df.select("*", F.explode(F.filter(F.array(value), accept)).alias(out))


def rows_where(df, value, accept):
    """Keep the rows whose value `accept` holds for, where this stands: a costly filter stays behind
    a repartition and does not compute the value again."""
    return with_kept(df, "_value", value, accept).drop("_value")


def hash_int(seed, *keys):
    """A 60-bit integer from the seed and the keys, the same in every engine that has md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k) if isinstance(k, str) else k for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def empty_array(kind):
    return F.array().cast(f"array<{kind}>")


def running_sum(values):
    """Running sums inside each array of longs.

    Spark has no scan over an array, and folding with `aggregate` copies the array at
    every step, so this one goes through Arrow.
    """

    @F.arrow_udf("array<bigint>")
    def cumulate(lists: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)])
        before = np.repeat(total[ends - lengths], lengths)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(total[1:] - before))

    return apart(cumulate)(F.coalesce(values.cast("array<bigint>"), empty_array("bigint")))
