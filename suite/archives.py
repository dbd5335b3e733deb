"""Image trees and archives written from a table's rows, as inputs of the sources that read them."""

import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from gridprep.sources.png import RGBA, SIGNATURE


def encode_png(height, width, data):
    """PNG bytes of rows of B, G, R and alpha."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, 4)[:, :, [2, 1, 0, 3]].reshape(height, width * 4)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), pixels], axis=1).tobytes()

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    header = struct.pack(">IIBBBBB", width, height, 8, RGBA, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def with_png(images):
    """(generation, game_name, name, content) of images with four channels."""

    @F.arrow_udf("binary")
    def encode(height: pa.Array, width: pa.Array, data: pa.Array) -> pa.Array:
        return pa.array(map(encode_png, height.to_pylist(), width.to_pylist(), data.to_pylist()), pa.binary())

    return images.select("generation", "game_name", "name", encode("height", "width", "data").alias("content"))


def write_tree(files, root):
    """Each row of (generation, game_name, name, content) as a file of its own; a repeated task writes the same again."""

    def run(batches):
        store, base = fs.FileSystem.from_uri(root)
        made = set()
        for batch in batches:
            for generation, game_name, name, content in zip(*[batch[c].to_pylist() for c in ("generation", "game_name", "name", "content")]):
                folder = f"{base}/{generation}/{game_name}"
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.mapInArrow(run, "n bigint").agg(F.sum("n")).head()[0]


def write_archives(members, folder):
    """A tar.gz archive for each generation of each batch of (generation, member, content); `generation` is a number.

    Files of a lost task may stay; they hold the same members as those of its repetition.
    """

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            rows = list(zip(*[batch[c].to_pylist() for c in ("generation", "member", "content")]))
            for number in sorted({r[0] for r in rows}):
                place = f"{base}/generation-{number}-{uuid.uuid4().hex}.tar.gz"
                with store.open_output_stream(place, compression=None) as out, tarfile.open(fileobj=out, mode="w|gz") as archive:
                    for _, name, content in (r for r in rows if r[0] == number):
                        member = tarfile.TarInfo(name)
                        member.size = len(content)
                        archive.addfile(member, io.BytesIO(content))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return members.mapInArrow(run, "n bigint").agg(F.sum("n")).head()[0]
