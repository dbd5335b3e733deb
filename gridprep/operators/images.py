"""Image rows: (height, width, n_channels, data) with rows top-down and channels B, G, R, A.

Pixels have to be read out of the bytes of each image; that is done on Arrow batches, image
by image, with numpy.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from gridprep.constants import BLANK, BLANK_ABOVE, BLANK_BELOW, PALETTE_START
from gridprep.functions.pixels import over_white
from gridprep.functions.text import apart

PIXEL_FIELDS = "y INT, x INT, r INT, g INT, b INT, a INT"


def encode_images(images, out="data"):
    """Palette grid text of each image, laid over white; an unreadable image is an error."""

    @F.arrow_udf("string")
    def grid_text(height: pa.Array, width: pa.Array, channels: pa.Array, data: pa.Array) -> pa.Array:
        texts = []
        for h, w, n, raw in zip(height.to_pylist(), width.to_pylist(), channels.to_pylist(), data):
            if not raw.is_valid or not h or h < 0:
                raise ValueError("could not decode image")
            pixels = np.frombuffer(raw.as_buffer(), np.uint8).reshape(h, w, n)
            if n == 4:
                share = pixels[:, :, 3:] / 255.0
                pixels = (pixels[:, :, :3] * share + 255 * (1 - share)).astype(np.uint8)
            blank = (pixels.min(axis=2) > BLANK_ABOVE) | (pixels.max(axis=2) < BLANK_BELOW)
            level = (pixels // 64).astype(np.uint8)
            b, r = level[:, :, 0], level[:, :, -1]
            g = level[:, :, level.shape[2] // 2]
            chars = np.full((h, 2 * w), ord(" "), np.uint8)
            chars[:, ::2] = np.where(blank, ord(BLANK), r * 16 + g * 4 + b + PALETTE_START)
            chars[:, -1] = ord("\n")
            texts.append(chars.tobytes()[:-1].decode("ascii"))
        return pa.array(texts, pa.string())

    return images.withColumn(
        out, apart(grid_text)(F.col("height"), F.col("width"), F.col("n_channels"), F.col("data"))
    ).drop("height", "width", "n_channels")


def explode_pixels(images, keys):
    """One row per pixel with the key columns; gray becomes three channels, no alpha is opaque."""
    key_fields = [images.schema[k] for k in keys]
    pixel_schema = T.StructType(key_fields + T.StructType.fromDDL(PIXEL_FIELDS).fields)
    names = pixel_schema.fieldNames()

    def pixel_rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                h, w, n = (row.column(c)[0].as_py() for c in ("height", "width", "n_channels"))
                raw = np.frombuffer(row.column("data")[0].as_buffer(), np.uint8).reshape(h * w, n)
                b, r = raw[:, 0], raw[:, min(n, 3) - 1]
                g = raw[:, 1] if n >= 3 else b
                a = raw[:, 3] if n == 4 else np.full(h * w, 255)
                position = np.arange(h * w)
                columns = [pa.repeat(row.column(k)[0], h * w) for k in keys]
                columns += [
                    pa.array(c.astype(np.int32))
                    for c in (position // w, position % w, r, g, b, a)
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    wanted = images.select(*keys, "height", "width", "n_channels", "data")
    return wanted.mapInArrow(pixel_rows, pixel_schema)


def composite(pixels, kind="double"):
    """Lay the pixels of a pixel table over white and drop alpha."""
    return pixels.withColumns(
        {c: over_white(F.col(c), F.col("a"), kind) for c in ("r", "g", "b")}
    ).drop("a")


def pixels_to_grids(pixels, keys, token):
    """Grid text from a table of pixel tokens. A group is one image."""
    rows = pixels.groupBy(*keys, "y").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("x", token.alias("t")))), lambda c: c["t"]),
            " ",
        ).alias("line")
    )
    return rows.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("y", "line"))), lambda c: c["line"]), "\n"
        ).alias("data")
    )


def to_tensor(images, out="tensor"):
    """Floats in [0, 1], channel by channel in the order R, G, B."""

    @F.arrow_udf("array<float>")
    def planes(height: pa.Array, width: pa.Array, channels: pa.Array, data: pa.Array) -> pa.Array:
        tensors = []
        for h, w, n, raw in zip(height.to_pylist(), width.to_pylist(), channels.to_pylist(), data):
            pixels = np.frombuffer(raw.as_buffer(), np.uint8).reshape(h, w, n)
            rgb = np.repeat(pixels, 3, axis=2) if n == 1 else pixels[:, :, 2::-1]
            tensors.append((rgb.transpose(2, 0, 1).astype(np.float32) / np.float32(255)).ravel())
        return pa.array(tensors, pa.list_(pa.float32()))

    return images.withColumn(
        out, apart(planes)(F.col("height"), F.col("width"), F.col("n_channels"), F.col("data"))
    )
