"""Images in trees and in archives."""

import gzip
import re
import tarfile
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from gridprep.functions.names import normalise_member_path
from gridprep.sources.files import list_files, path_keys, tree_files
from gridprep.sources.tables import KEY, last_per_key

MEMBERS_PER_BATCH = 256
BATCH_BYTES = 16 << 20
ARCHIVE_PATTERN = r"generation-(\d+)"


def decode_images(files):
    """(keys, height, width, n_channels, data) of rows read by the image source."""
    return files.select(
        *path_keys(F.col("image.origin")),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("n_channels"),
        F.col("image.data").alias("data"),
    )


def scan_images(spark, root, generation=None, game_name=None, drop_invalid=False):
    """Decoded PNG files of a tree; data is rows of B, G, R and maybe A."""
    _, reader, folder, tasks = tree_files(spark, root, generation, game_name, ".png")
    return decode_images(reader.format("image").option("dropInvalid", str(drop_invalid).lower()).load(folder).coalesce(tasks))


def extract_archives(spark, pattern):
    """(archive, position, generation, member, content) of the PNG members of tar.gz archives.

    An archive can only be read front to back, so each is one task. It is streamed from the file system that all
    executors share, and its members leave the task in batches: no archive is held whole, whatever its size. A batch
    closes at MEMBERS_PER_BATCH members or BATCH_BYTES bytes. A cut-off archive is an error.
    """
    number = F.regexp_extract(F.regexp_extract("path", r"([^/]+)$", 1), ARCHIVE_PATTERN, 1)
    archives = list_files(spark, pattern).select("path", number.alias("generation")).where("generation <> ''")
    # about one task for each archive
    spread = archives.withColumn("generation", F.col("generation").cast("int")).repartition(max(1, archives.count()), "path")

    def members(batches):
        for batch in batches:
            for path, generation in zip(batch["path"].to_pylist(), batch["generation"].to_pylist()):
                with _opened(path) as stream, gzip.open(stream) as unpacked, tarfile.open(fileobj=unpacked, mode="r|") as archive:
                    rows, size = [], 0
                    for position, member in enumerate(archive):
                        if member.isfile() and member.name.endswith(".png"):
                            content = archive.extractfile(member).read()
                            rows.append((path, position, generation, member.name, content))
                            size += len(content)
                        if len(rows) == MEMBERS_PER_BATCH or size > BATCH_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
                    # to the end of the file: a cut-off one has no end mark, a damaged one another checksum
                    while unpacked.read(1 << 20):
                        pass
                    if rows:
                        yield _batch(rows)

    return spread.mapInArrow(members, "archive STRING, position INT, generation INT, member STRING, content BINARY")


def _opened(path):
    """A stream of the file at a path as Spark lists it: not escaped, a local one as file:/folder."""
    local = re.match("file:/+", path)
    if local:
        return fs.LocalFileSystem().open_input_stream("/" + path[local.end():], compression=None)
    store, place = fs.FileSystem.from_uri(quote(path, safe="/:@"))
    return store.open_input_stream(place, compression=None)


def _batch(rows):
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
    names = ["archive", "position", "generation", "member", "content"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


def name_members(members, prefix):
    """Keyed rows of the members whose path is one of an image; the last member with a key counts."""
    path = normalise_member_path(F.col("generation"), F.col("member"), prefix)
    named = members.withColumn("path", path).where("path IS NOT NULL")
    parts = F.split("path", "/")
    keyed = named.select(
        F.get(parts, F.lit(0)).alias("generation"),
        F.get(parts, F.lit(1)).alias("game_name"),
        F.get(parts, F.lit(2)).alias("name"),
        "archive", "position", "content",
    )
    return last_per_key(keyed, KEY, ["archive", "position"]).drop("archive", "position")
