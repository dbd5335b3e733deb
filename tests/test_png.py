"""PNG bytes: the same pixels as Spark's image source, and the way from archives to grids."""

import io
import struct
import tarfile
import zlib

import numpy as np
import pytest
from files import png, solid, write
from pyspark.sql import functions as F

from gridprep.operators.images import encode_images
from gridprep.plans.jobs import archives_to_images, images_to_grids, stored_images
from gridprep.sources.images import scan_images
from gridprep.sources.png import BadPng, decode, decode_png


def raw_png(width, height, colour, lines, extra=b"", depth=8):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + extra + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def palette_chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(pixels, step):
    """Lines of all five filters in turn."""
    height, stride = pixels.shape
    out, above = [], np.zeros(stride, int)
    for y in range(height):
        line, kind = pixels[y].astype(int), y % 5
        left = np.concatenate([np.zeros(step, int), line[:-step]])
        corner = np.concatenate([np.zeros(step, int), above[:-step]])
        base = left + above - corner
        paeth = np.where((abs(base - left) <= abs(base - above)) & (abs(base - left) <= abs(base - corner)), left, np.where(abs(base - above) <= abs(base - corner), above, corner))
        guess = [0 * line, left, above, (left + above) // 2, paeth][kind]
        out.append(bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes())
        above = line
    return b"".join(out)


def test_same_as_the_image_source(spark, tmp_path):
    random = np.random.default_rng(1)
    files = {}
    for colour, step in ((0, 1), (2, 3), (6, 4)):
        pixels = random.integers(0, 256, (12, 9 * step), dtype=np.uint8)
        files[f"{colour}.png"] = raw_png(9, 12, colour, filtered(pixels, step))
    files["palette.png"] = raw_png(2, 1, 3, b"\x00\x01\x00", palette_chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6])))
    for name, data in files.items():
        write(tmp_path, "gen3", "game", name, data)
    found = {r.name: (r.height, r.width, r.n_channels, bytes(r.data)) for r in scan_images(spark, str(tmp_path)).collect()}
    assert found == {name: decode(data) for name, data in files.items()}


def test_gray_and_palette_with_alpha():
    assert decode(raw_png(1, 1, 4, b"\x00\x07\x80")) == (1, 1, 4, bytes([7, 7, 7, 128]))
    extra = palette_chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6])) + palette_chunk(b"tRNS", bytes([9]))
    assert decode(raw_png(2, 1, 3, b"\x00\x00\x01", extra)) == (1, 2, 4, bytes([3, 2, 1, 9, 6, 5, 4, 255]))


@pytest.mark.parametrize("data", [
    b"", b"no png", png(solid(4, (1, 2, 3)))[:-6], raw_png(1, 1, 2, b"\x00\x01"), raw_png(1, 1, 2, b"\x09\x01\x02\x03"), raw_png(1, 1, 0, b"\x00\x01", depth=16),
    raw_png(1, 1, 3, b"\x00\x05", palette_chunk(b"PLTE", bytes(3))), png(solid(4, (1, 2, 3))).replace(b"IDAT", b"IDAU"),
])
def test_bad_bytes_are_errors(data):
    with pytest.raises(BadPng):
        decode(data)


def test_nulls_and_dropped_files(spark):
    df = spark.createDataFrame([(1, bytearray(png(solid(2, (9,))))), (2, None), (3, bytearray(b"no png"))], "k int, content binary")
    rows = {r.k: (r.height, r.data) for r in decode_png(df, drop_invalid=True).collect()}
    assert rows == {1: (2, bytearray([9] * 4)), 2: (None, None)}
    with pytest.raises(Exception, match="signature"):
        decode_png(df).collect()


def test_archives_to_grids(spark, tmp_path):
    images = {"1.png": solid(40, (128, 0, 0), (255, 255, 255)), "2.png": solid(40, (0, 128, 0), (255, 255, 255)), "back/3.png": solid(40, (0, 0, 128))}
    for number in (3, 4):
        with tarfile.open(tmp_path / f"generation-{number}.tar.gz", "w:gz") as archive:
            for name, pixels in images.items():
                data = png(pixels)
                member = tarfile.TarInfo(f"pokemon/main-sprites/red/{name}")
                member.size = len(data)
                archive.addfile(member, io.BytesIO(data))
    store = str(tmp_path / "images")
    archives_to_images(spark, str(tmp_path / "*.tar.gz"), store, "pokemon/main-sprites")
    archives_to_images(spark, str(tmp_path / "*.tar.gz"), store, "pokemon/main-sprites")  # again: rows are replaced, not added
    stored = spark.read.parquet(store)
    assert stored.count() == 4
    decoded = stored_images(stored, ["gen3"])
    assert decoded.select("height", "width", "n_channels").distinct().collect() == [(40, 40, 3)]
    grids = images_to_grids(stored_images(stored))
    assert sorted((r.generation, r.name) for r in grids.collect()) == [(f"gen{g}", f"00{n}.txt") for g in (3, 4) for n in (1, 2)]
    tokens = encode_images(decoded).select(F.explode(F.split("data", r"\s+")).alias("t")).where("t <> '~' AND t <> ''").distinct().count()
    assert tokens == 2


def test_files_elsewhere_are_errors(spark, tmp_path):
    write(tmp_path, "gen3", "game", "1.png", png(solid(2, (1, 2, 3))))
    assert scan_images(spark, str(tmp_path)).count() == 1
    write(tmp_path, "gen3", "game", "deeper/2.png", png(solid(2, (1, 2, 3))))
    with pytest.raises(ValueError, match="deeper"):
        scan_images(spark, str(tmp_path))


def test_a_scan_has_one_root(spark, tmp_path):
    for i in range(12):
        write(tmp_path, "gen3", f"game{i % 2}", f"{i}.png", png(solid(2, (1, 2, 3))))
    plan = scan_images(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "(1 paths)" in plan
