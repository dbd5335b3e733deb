"""Batches and inventories."""

from itertools import zip_longest
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridprep.operators.packed import PACKED, Packed, stored_packed, unpack_batches
from gridprep.session import ensure_checkpoint_dir

# (name in the batch, column, column that decides whether the batch carries it)
TRAINING_FIELDS = [
    ("input_ids", "input_ids", None),
    ("labels", "labels", None),
    ("attention_mask", "attention_mask", None),
    ("identity_idx", "identity_idx", None),
    ("row_ids", "row_ids", "row_ids"),
    ("col_ids", "col_ids", "col_ids"),
    ("type1", "type1_idx", "type1_idx"),
    ("type2", "type2_idx", "type1_idx"),
    ("is_shiny", "is_shiny", "type1_idx"),
    ("generation", "generation_idx", "type1_idx"),
    ("evolution_stage", "evolution_stage_idx", "type1_idx"),
    ("has_evolution", "has_evolution_idx", "type1_idx"),
    ("name_chars", "name_chars", "name_chars"),
    ("color_shift", "color_shift", "color_shift"),
    *[(field, field, field) for field in (
        "is_legendary_idx", "is_mythical_idx", "is_baby_idx", "color_idx", "shape_idx", "habitat_idx",
    )],
]
IGNORED_LABEL = -100
ROWS_PER_RANGE = 4096


def collate(df, order, batch_size=16, fields=TRAINING_FIELDS):
    """One row per batch of consecutive rows in the order of the `order` columns; nulls come first and rows
    that are equal there follow each other in any order. Each field is an array over the batch; it is
    null if its deciding column is null in any row or missing from the table. Labels are the ids, with
    IGNORED_LABEL where the attention mask is 0, so that padding counts in no loss.

    The rows are cut into ranges of the order once, sorted, numbered and put into batches where they lie. Only the rows of a
    batch that spans two ranges, at most batch_size - 1 of each range at either end, are moved again. Their arrays
    are packed while they move and lie; `df` may be Packed itself, as `stored_packed` gives it.
    """
    given = isinstance(df, Packed)
    schema_in = df.schema
    known = set(schema_in.names)
    ensure_checkpoint_dir((df.rows if given else df).sparkSession)
    masked = {"labels", "input_ids", "attention_mask"} <= known
    used = [(out, column, guard) for out, column, guard in fields
            if column in known and (guard is None or guard in known)]
    inputs = sorted({column for _, column, _ in used} | {guard for _, _, guard in used if guard})
    if not given:
        df = stored_packed((_masked(df) if masked else df).select(*inputs, *[c for c in order if c not in inputs]), "rows", order)
    held = [c for c in df.rows.columns if c in inputs or c == PACKED]
    place = F.monotonically_increasing_id()
    parts = max(1, ceil(df.rows.count() / ROWS_PER_RANGE))
    sorted_rows = df.rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        *held, F.spark_partition_id().alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_inside")
    ).checkpoint()
    sizes = sorted_rows.groupBy("_part").count()
    by_part = Window.orderBy("_part")  # one row per part
    bounds = sizes.select(
        "_part", (F.sum("count").over(by_part) - F.col("count")).alias("_start"), F.sum("count").over(by_part).alias("_end"),
        F.lead("_part").over(by_part).isNull().alias("_last"),
    )
    ranked = sorted_rows.join(F.broadcast(bounds), "_part").withColumn("_rank", F.col("_start") + F.col("_inside"))
    first = F.floor(F.col("_rank") / batch_size) * batch_size
    spans = (first < F.col("_start")) | (~F.col("_last") & (first + batch_size > F.col("_end")))
    ranked = Packed(ranked.select("_rank", *held, spans.alias("_spans")), df.schema, df.leave)
    late = given and masked and "labels" in inputs
    kinds = (_masked(ranked.unpacked()) if late else ranked.unpacked()).schema
    schema = ", ".join(["batch bigint", "n bigint", *(f"`{out}` array<{kinds[column].dataType.simpleString()}>" for out, column, _ in used)])
    columns = ["_rank", *sorted({*inputs, "input_ids", "attention_mask"} if late else inputs)]
    unpack = unpack_batches(df.schema, df.leave, columns) if PACKED in held else iter
    whole = ranked.rows.where("NOT _spans").drop("_spans").mapInArrow(_batches(batch_size, used, unpack, to_arrow_type(kinds["labels"].dataType) if late else None), schema)

    def gathered(column):
        return F.transform("_rows", lambda row: row[column])

    rest = ranked._replace(rows=ranked.rows.where("_spans")).unpacked()
    cut = (_masked(rest) if late else rest).groupBy(F.floor(F.col("_rank") / batch_size).alias("batch")).agg(
        F.sort_array(F.collect_list(F.struct("_rank", *inputs))).alias("_rows"), F.count("*").alias("n"),
        *[F.bool_and(F.col(g).isNotNull()).alias(f"_has_{g}") for g in {guard for _, _, guard in used if guard}],
    ).select("batch", "n", *[
        (gathered(column) if guard is None else F.when(F.col(f"_has_{guard}"), gathered(column))).alias(out) for out, column, guard in used
    ])
    names = {out for out, _, _ in used}
    ordered = [F.col(out) for out, _, _ in used] + [F.lit(None).alias(out) for out, _, _ in fields if out not in names]
    return whole.unionByName(cut).select("batch", "n", *ordered)


def _masked(df):
    return df.withColumn("labels", F.zip_with(
        "input_ids", "attention_mask", lambda i, m: F.when(m == 0, F.lit(IGNORED_LABEL)).otherwise(i)
    ))


def _masked_lists(ids, mask, kind):
    """`_masked` of two columns of lists; `kind` is the type of the labels."""
    lengths, others = (pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False) for x in (ids, mask))
    if (lengths != others).any():
        pairs = zip(ids.to_pylist(), mask.to_pylist())
        return pa.array([None if i is None or m is None else [IGNORED_LABEL if b == 0 else a for a, b in zip_longest(i, m)] for i, m in pairs], kind)
    hidden = pc.fill_null(pc.equal(mask.flatten(), 0), False)
    labels = pc.if_else(hidden, pa.scalar(IGNORED_LABEL, kind.value_type), ids.flatten().cast(kind.value_type))
    ends = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), labels, mask=ids.is_null())


def _batches(batch_size, used, unpack=iter, labels=None):
    """Batches of rows that lie one behind the other: lists over the columns as they are. With a type of `labels` these are made here."""
    def lists(rows):
        sizes = [batch_size] * (len(rows) // batch_size) + [len(rows) % batch_size] * (len(rows) % batch_size > 0)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        columns = [pa.array(rows.column("_rank").to_numpy()[offsets[:-1]] // batch_size), pa.array(sizes, pa.int64())]
        for _, column, guard in used:
            absent = None
            if guard is not None:
                gaps = np.concatenate([[0], np.cumsum(rows.column(guard).is_null().to_numpy(zero_copy_only=False))])
                absent = pa.array(np.diff(gaps[offsets]) > 0)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), rows.column(column), mask=absent))
        return pa.RecordBatch.from_arrays(columns, names=["batch", "n", *(out for out, _, _ in used)])

    def run(batches):
        rest = None
        for batch in unpack(batches):
            if labels is not None:
                masked = _masked_lists(batch.column("input_ids"), batch.column("attention_mask"), labels)
                batch = batch.set_column(batch.schema.get_field_index("labels"), "labels", masked)
            rows = batch if rest is None else pa.concat_batches([rest, batch])
            full = len(rows) - len(rows) % batch_size
            if full:
                yield lists(rows.slice(0, full))
            rest = rows.slice(full)
        if rest is not None and len(rest):
            yield lists(rest)  # the last batch of all

    return run


def inventory(df):
    """Images per generation and game, per generation, and in all."""
    return df.rollup("generation", "game_name").agg(
        F.count("*").alias("sprites"), F.grouping_id().cast("int").alias("level")
    )
