"""Small PNG files, written without an image library."""

import struct
import zlib

COLOR_TYPE = {1: 0, 3: 2, 4: 6}


def png(rows):
    """PNG bytes of rows of pixels, each a tuple of 1, 3 or 4 bytes (gray, R G B, R G B A)."""
    height, width, channels = len(rows), len(rows[0]), len(rows[0][0])
    raw = b"".join(b"\0" + bytes(v for pixel in row for v in pixel) for row in rows)

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", width, height, 8, COLOR_TYPE[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def solid(size, pixel, border=None):
    """A square of one colour, maybe with a border of another."""
    edge = border or pixel
    return [
        [edge if y in (0, size - 1) or x in (0, size - 1) else pixel for x in range(size)] for y in range(size)
    ]


def write(root, generation, game_name, name, content):
    path = root / generation / game_name / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return path
