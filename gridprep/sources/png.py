"""Decoding PNG bytes on Arrow batches."""

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridprep.functions.text import apart

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# colour type -> samples per pixel
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
GRAY, RGB, PALETTE, GRAY_ALPHA, RGBA = 0, 2, 3, 4, 6
IMAGE = "struct<height:int,width:int,n_channels:int,data:binary>"


class BadPng(ValueError):
    """Bytes that are no PNG of a supported kind."""


def _chunks(data):
    place = len(SIGNATURE)
    while place + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, place)
        body = data[place + 8:place + 8 + size]
        if len(body) < size or place + 12 + size > len(data):
            raise BadPng("a chunk is cut off")
        if struct.unpack_from(">I", data, place + 8 + size)[0] != zlib.crc32(data[place + 4:place + 8 + size]):
            raise BadPng("a chunk has a wrong checksum")
        yield kind, body
        place += 12 + size
        if kind == b"IEND":
            return
    raise BadPng("the end is missing")


def _unfilter(raw, height, stride, step):
    """Undo the filter of every line; all but the left-looking ones work on whole lines."""
    lines = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.uint8)  # a line of zeros stands above the first
    for y in range(height):
        kind, line, above = lines[y, 0], lines[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:  # each channel is a running sum
            for c in range(step):
                out[y + 1, c::step] = np.cumsum(line[c::step], dtype=np.uint8)
        elif kind == 2:
            out[y + 1] = line + above
        elif kind in (3, 4):
            here, line, above = out[y + 1], line.astype(int), above.astype(int)
            for x in range(stride):
                left = int(here[x - step]) if x >= step else 0
                if kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    corner = above[x - step] if x >= step else 0
                    base = left + above[x] - corner
                    guess = min((left, above[x], corner), key=lambda v: abs(base - v))
                here[x] = (line[x] + guess) & 255
        else:
            raise BadPng(f"filter {kind}")
    return out[1:]


def decode(data):
    """(height, width, channels, bytes) with rows of B, G, R and maybe A, or of gray, as Spark's image source has them."""
    if not data.startswith(SIGNATURE):
        raise BadPng("the signature is missing")
    header, palette, alpha, packed = None, None, None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            packed.append(body)
    if header is None:
        raise BadPng("the header is missing")
    width, height, depth, colour, _, _, interlace = header
    if depth != 8 or interlace or colour not in SAMPLES or (alpha is not None and colour != PALETTE):
        raise BadPng(f"bit depth {depth}, colour type {colour}, interlace {interlace}")
    step = SAMPLES[colour]
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as error:
        raise BadPng(str(error)) from None
    if len(raw) != height * (width * step + 1):
        raise BadPng("the pixels have another size than the header states")
    pixels = _unfilter(raw, height, width * step, step).reshape(height, width, step)
    if colour == PALETTE:
        if palette is None or pixels.max(initial=0) >= len(palette):
            raise BadPng("a colour is not in the palette")
        index = pixels[:, :, 0]
        pixels = palette[index]
        if alpha is not None:
            full = np.full(len(palette), 255, np.uint8)
            full[:len(alpha)] = alpha[:len(palette)]
            pixels = np.concatenate([pixels, full[index][:, :, None]], axis=2)
    elif colour == GRAY_ALPHA:
        pixels = np.concatenate([np.repeat(pixels[:, :, :1], 3, axis=2), pixels[:, :, 1:]], axis=2)
    if pixels.shape[2] >= 3:
        pixels = np.concatenate([pixels[:, :, 2::-1], pixels[:, :, 3:]], axis=2)
    return height, width, pixels.shape[2], pixels.tobytes()


def decode_png(df, content="content", drop_invalid=False):
    """Replace PNG bytes by height, width, n_channels and data, the columns that `images_to_grids` reads.

    8-bit gray, RGB, RGBA, palette and gray with alpha (as RGBA); anything else is an error, or is dropped. A
    null stays one.
    """

    @F.arrow_udf(IMAGE)
    def decoded(column: pa.Array) -> pa.Array:
        rows = []
        for value in column:
            try:
                rows.append(None if not value.is_valid else dict(zip(("height", "width", "n_channels", "data"), decode(value.as_py()))))
            except BadPng:
                if not drop_invalid:
                    raise
                rows.append({"height": -1, "width": -1, "n_channels": -1, "data": b""})
        return pa.array(rows, pa.struct([("height", pa.int32()), ("width", pa.int32()), ("n_channels", pa.int32()), ("data", pa.binary())]))

    rows = df.withColumn("_image", apart(decoded)(F.col(content)))
    if drop_invalid:
        rows = rows.where("_image IS NULL OR _image.height >= 0")
    return rows.select("*", "_image.*").drop("_image", content)
