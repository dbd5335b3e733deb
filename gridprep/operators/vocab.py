"""Vocabularies and lookups in them."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from gridprep import schemas
from gridprep.constants import (
    BACKGROUND_WEIGHT, BLANK, MAX_BROADCAST_ROWS, ROW_TOKENS, SPECIAL_TOKENS, UNK_ID,
)
from gridprep.functions.text import apart
from gridprep.operators.joins import ROWS_PER_TASK, bounded_rows, spread_join
from gridprep.operators.ranking import global_rank
from gridprep.session import stored


def distinct_tokens(df, text="text"):
    """Each token of the corpus once; repeats inside a batch of texts go before the shuffle."""

    def tokens(batches):
        for batch in batches:
            found = set()
            for value in batch.column(0):
                found.update((value.as_py() or "").split())
                if len(found) > PART_ELEMENTS:
                    yield _tokens(found)
                    found = set()
            yield _tokens(found)

    return df.select(text).mapInArrow(tokens, "token string").distinct()


def _tokens(found):
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], ["token"])


def build_vocab(df, text="text", special=SPECIAL_TOKENS):
    """Special tokens first, then the other tokens of the corpus in code-point order."""
    spark = df.sparkSession
    fixed = spark.createDataFrame([(t, i) for i, t in enumerate(special)], schemas.VOCAB)
    found = distinct_tokens(df, text).join(F.broadcast(fixed.select("token")), "token", "left_anti")
    ranked = global_rank(found, ["token"], "id")
    return fixed.unionByName(ranked.select("token", (F.col("id") + len(special)).cast("int").alias("id")))


def encode_ids(df, vocab, key=None, tokens="tokens", out="input_ids", unknown=UNK_ID, limit=MAX_BROADCAST_ROWS):
    """Replace tokens, an array or a text with blanks between them, by their ids.

    A vocabulary of up to `limit` rows is sent to the tasks and no row moves. A larger one is joined, with
    the same result for any rows: `key` is not needed. Of a token listed twice the smallest id counts.
    """
    is_text = df.schema[tokens].dataType == T.StringType()
    vocab = _one_per_key(vocab, "token", "id")
    rows = bounded_rows(vocab, limit)
    if rows is None:
        return _lookup_by_join(df, vocab, tokens, out, unknown)
    known = [r["token"] for r in rows]
    ids = np.array([r["id"] for r in rows] + [unknown], dtype=np.int32)

    @F.arrow_udf("array<int>")
    def lookup(column: pa.Array) -> pa.Array:
        flat, ends = _flat_list(column, is_text)
        found = pc.index_in(flat, value_set=pa.array(known, flat.type))
        at = pc.fill_null(found, len(known)).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids[at]))

    return df.withColumn(out, apart(lookup)(F.col(tokens)))


def decode_ids(df, vocab, key=None, ids="input_ids", out="tokens", limit=MAX_BROADCAST_ROWS):
    """Replace an array of ids by their tokens; an id that is not listed becomes null."""
    vocab = _one_per_key(vocab, "id", "token")
    rows = bounded_rows(vocab, limit)
    if rows is None:
        return _lookup_by_join(df, vocab, ids, out, None)
    known = [r["id"] for r in rows]
    tokens = [r["token"] for r in rows]

    @F.arrow_udf("array<string>")
    def lookup(lists: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        at = pc.index_in(pc.cast(lists.flatten(), pa.int32()), value_set=pa.array(known, pa.int32()))
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens, pa.string()).take(at))

    return df.withColumn(out, apart(lookup)(F.col(ids)))


PART_ELEMENTS = 1 << 20
PART_BYTES = 32 << 20


def _lookup_by_join(df, table, column, out, default, spread_from=ROWS_PER_TASK, part_elements=PART_ELEMENTS):
    """Look the elements of arrays up in a table that is too large for the tasks, in two levels.

    The rows are written in numbered parts of a bounded number of elements and bytes. Each part's distinct elements, not
    its arrays, are joined with the table; what is found is the part's own dictionary. Each part then meets its
    dictionary, once, and the arrays are translated in place. Parts do not depend on any value, so equal rows, null keys
    and frequent elements need no care; the rows of an element that very many parts hold are spread over tasks.
    """
    source, target = table.columns
    is_text = df.schema[column].dataType == T.StringType()
    rows = stored(df.mapInArrow(_in_parts(column, is_text, part_elements), T.StructType([*df.schema.fields, _PART])), "parts")
    listed = F.array_remove(F.split(column, " "), "") if is_text else F.col(column)
    distinct = rows.select("_part", F.explode(listed).alias(source)).where(F.col(source).isNotNull()).distinct()
    found = spread_join(distinct, table, source, spread=["_part"], rows_per_task=spread_from)
    # a name of its own: both sides come from the same rows
    found = found.select(F.col("_part").alias("_of"), source, target)
    kind = table.schema[target].dataType
    schema = T.StructType([*[f for f in rows.schema.fields if f.name not in ("_part", out)], T.StructField(out, T.ArrayType(kind))])
    arrow_type = to_arrow_type(kind)

    def translate(part: pa.Table, dictionary: pa.Table) -> pa.Table:
        flat, ends = _flat_list(part[column].combine_chunks(), is_text)
        known = dictionary[source].combine_chunks()
        at = pc.index_in(flat.cast(known.type), value_set=known, skip_nulls=True)
        values = pc.fill_null(pc.take(dictionary[target].combine_chunks(), at).cast(arrow_type), pa.scalar(default, arrow_type))
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
        kept = [f.name for f in schema.fields if f.name != out]
        return pa.Table.from_arrays([*[part[c] for c in kept], lists], [*kept, out])

    return rows.groupBy("_part").cogroup(found.groupBy("_of")).applyInArrow(translate, schema)


_PART = T.StructField("_part", T.LongType())


def _flat_list(column, is_text):
    """(elements, ends) of all arrays, or of texts cut at blanks, of a column; a null has no elements."""
    lists = pc.split_pattern(column, " ") if is_text else column
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    flat = lists.flatten()
    if is_text:
        # nothing stands between two blanks, at the ends or in an empty text
        full = pc.not_equal(flat, "")
        ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[ends]
        flat = flat.filter(full)
    return flat, ends


def _in_parts(column, is_text, most):
    """Batches with the number of their part; a part closes at `most` elements or PART_BYTES bytes, or after one row."""

    def run(batches):
        first = TaskContext.get().partitionId() << 33
        number, elements, size = 0, 0, 0
        for batch in batches:
            values = batch.column(column)
            counts = pc.fill_null(pc.binary_length(values) if is_text else pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
            # a text has at most every other byte an element
            each = batch.nbytes // max(1, batch.num_rows)
            numbers = np.empty(batch.num_rows, np.int64)
            for i, n in enumerate(counts.tolist()):
                n = n // 2 + 1 if is_text else n
                if elements and (elements + n > most or size + each > PART_BYTES):
                    number, elements, size = number + 1, 0, 0
                elements, size = elements + n, size + each
                numbers[i] = first + number
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], [*batch.schema.names, "_part"])

    return run


def _one_per_key(vocab, key, value):
    """The smallest value of each key, so that a repeated key means the same whatever its size."""
    return vocab.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value))


def marker_ids(vocab):
    """Ids of the row markers, in row order."""
    return vocab.where(F.col("token").isin(ROW_TOKENS)).orderBy("token")


def token_weights(vocab, weight=BACKGROUND_WEIGHT):
    """Lower weight for tokens made of blanks only."""
    blank_only = F.col("token").rlike(f"^{BLANK}+$")
    return vocab.withColumn("weight", F.when(blank_only, F.lit(weight)).otherwise(F.lit(1.0)))
