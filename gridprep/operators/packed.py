"""Rows with long arrays of whole numbers, kept small while they are stored or moved."""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_type

from gridprep.session import TEXT_BATCH_BYTES, bound_batches, shared_folder

PACKED = "_packed"
_WHOLE = T.ByteType, T.ShortType, T.IntegerType, T.LongType
_WIDTHS = [np.dtype(t) for t in ("<i1", "<i2", "<i4", "<i8")]
# of each array of a row: its width (an index of _WIDTHS, -1 for a null array), its length and whether elements are null
_HEAD = np.dtype([("width", "<i1"), ("gaps", "<i1"), ("length", "<i4")])
_SIZE = np.dtype("<i8")


def arrays_of(schema, leave=()):
    """The columns that are packed: arrays of whole numbers but for those in `leave`."""
    return [f.name for f in schema.fields
            if f.name not in leave and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, _WHOLE)]


def pack_arrays(df, leave=()):
    """The rows with all arrays of whole numbers in one binary column: each number in as few bytes as its column needs
    in its batch, and the arrays of a row compressed together, so that arrays that are alike in a row are kept about once."""
    names = arrays_of(df.schema, leave)
    if not names:
        return df
    kept = [f for f in df.schema.fields if f.name not in names]
    bound_batches(df.sparkSession)
    return df.mapInArrow(_pack(names, [f.name for f in kept]), T.StructType([*kept, T.StructField(PACKED, T.BinaryType())]))


class Packed(NamedTuple):
    """Rows of `pack_arrays`, all columns or some of them, and the schema they had before."""

    rows: DataFrame
    schema: T.StructType
    leave: tuple = ()

    def unpacked(self):
        """The rows as they were before; columns that they have besides stay behind the others."""
        if PACKED not in self.rows.columns:
            return self.rows
        bound_batches(self.rows.sparkSession)
        names = arrays_of(self.schema, self.leave)
        before = [f for f in self.schema.fields if f.name in names or f.name in self.rows.columns]
        more = [f for f in self.rows.schema.fields if f.name not in self.schema.fieldNames() and f.name != PACKED]
        fields = [*before, *more]
        return self.rows.mapInArrow(unpack_batches(self.schema, self.leave, [f.name for f in fields]), T.StructType(fields))


def stored_packed(df, purpose="table", leave=()):
    """The table as files in the shared folder, its arrays packed."""
    path = shared_folder(df.sparkSession, purpose)
    packed = pack_arrays(df, leave)
    packed.write.option("compression", "zstd").parquet(path)
    return Packed(df.sparkSession.read.schema(packed.schema).parquet(path), df.schema, tuple(leave))


def _pack(names, kept):
    def run(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            columns = [_narrowed(batch.column(name)) for name in names]
            packed = []
            for i in range(batch.num_rows):
                parts = [column(i) for column in columns]
                raw = b"".join([head for head, _ in parts] + [body for _, body in parts])
                packed.append(_SIZE.type(len(raw)).tobytes() + codec.compress(raw, asbytes=True))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(packed, pa.binary())], [*kept, PACKED])

    return run


def _narrowed(lists):
    """row -> (head, bytes) of its array."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    flat = lists.flatten()
    there = flat.is_valid().to_numpy(zero_copy_only=False) if flat.null_count else None
    values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
    least, most = (values.min(), values.max()) if len(values) else (0, 0)
    width = next(i for i, t in enumerate(_WIDTHS) if np.iinfo(t).min <= least and most <= np.iinfo(t).max)
    values = values.astype(_WIDTHS[width])
    null = lists.is_null().to_numpy(zero_copy_only=False)

    def of(row):
        low, high = ends[row], ends[row + 1]
        gaps = there is not None and not there[low:high].all()
        head = np.array((-1 if null[row] else width, gaps, high - low), _HEAD).tobytes()
        return head, values[low:high].tobytes() + (there[low:high].tobytes() if gaps else b"")

    return of


def unpack_batches(schema, leave, columns, most=TEXT_BATCH_BYTES):
    """A function for mapInArrow: batches of packed rows to batches of about `most` bytes of these columns, with their arrays."""
    names = arrays_of(schema, leave)
    kinds = {f.name: to_arrow_type(f.dataType.elementType) for f in schema.fields if f.name in names}

    def arrays(raws):
        heads = [np.frombuffer(raw, _HEAD, len(names)) for raw in raws]
        places = [len(names) * _HEAD.itemsize] * len(raws)
        for k, name in enumerate(names):
            kind = kinds[name]
            lengths = np.array([head[k]["length"] for head in heads], np.int64)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            values, gone = np.empty(ends[-1], kind.to_pandas_dtype()), None
            for i, (raw, head) in enumerate(zip(raws, heads)):
                width, gaps, n = head[k].item()
                if n:
                    values[ends[i]:ends[i + 1]] = np.frombuffer(raw, _WIDTHS[width], n, places[i])
                    places[i] += n * _WIDTHS[width].itemsize
                if gaps:
                    gone = np.zeros(ends[-1], bool) if gone is None else gone
                    gone[ends[i]:ends[i + 1]] = ~np.frombuffer(raw, bool, n, places[i])
                    places[i] += n
            null = pa.array([head[k]["width"] < 0 for head in heads], pa.bool_())
            yield name, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, kind, mask=gone), mask=null)

    def run(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            packed = batch.column(PACKED)
            sizes = [int(np.frombuffer(value.as_buffer(), _SIZE, 1)[0]) for value in packed]
            # numbers take up to eight bytes again
            parts = np.cumsum(np.array(sizes, np.int64) * 4) // most
            bounds = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(sizes)] if sizes else []
            for low, high in zip(bounds, bounds[1:]):
                raws = [codec.decompress(packed[i].as_buffer()[_SIZE.itemsize:], sizes[i], asbytes=True) for i in range(low, high)]
                found = dict(arrays(raws))
                rows = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([found[c] if c in found else rows.column(c) for c in columns], columns)

    return run
