"""WARC archives in Zstandard frames with a shared dictionary: writing and reading.

An archive (.warc.zst) starts with a skippable frame that holds the dictionary; each record is one
frame compressed with it. Archives are written by the tasks into a folder all of them share, under names no
other attempt uses; the rows a task returns name its finished archives, so what a lost or repeated
task left behind is never read as a result. They are read by Spark's binary file source, whole archive by whole
archive; `ARCHIVE_BYTES` bounds their size (a record that is larger has an archive of its own).
"""

import hashlib
import struct
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from gridprep.llm.tables import text_of, written
from gridprep.operators.joins import is_small

DICTIONARY_FRAME = 0x184D2A5D
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 32 << 10
DICTIONARY_SAMPLE = 400
SAMPLE_CHARACTERS = 8192
LEAST_REVISIT = 100
STEP = 16 << 10
MOST_SENT_DIGESTS = 200_000
DATE = "1970-01-01T00:00:00Z"  # pages have no fetch time
RECORD_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class BadArchive(ValueError):
    """An archive that does not hold what its headers say."""


def train_dictionary(payloads, size=DICTIONARY_BYTES):
    """A dictionary from sample payloads, or none if they are too few to learn from."""
    import zstandard

    payloads = [p for p in payloads if p]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, payloads)) // 8)), payloads).as_bytes()
    except zstandard.ZstdError:
        return b""


def _header(lines):
    return ("\r\n".join(f"{name}: {value}" for name, value in lines) + "\r\n\r\n").encode()


def _one_line(value):
    """A header value without control signs."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value)


def record(page_id, url, payload, digest, refers_to):
    """The bytes of a record; `refers_to` makes it a revisit of that page."""
    http = b"HTTP/1.1 200 OK\r\n" + _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(RECORD_SPACE, f'page {page_id}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Page-ID", "" if page_id is None else page_id),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Length", len(block)),
    ]
    if url is not None:
        lines.append(("WARC-Target-URI", _one_line(url)))
    if revisit:
        lines.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        lines.append(("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(RECORD_SPACE, f'page {refers_to}')}>"))
        lines.append(("WARC-Refers-To-Page", refers_to))
    return b"WARC/1.1\r\n" + _header(lines) + block + b"\r\n\r\n"


def _parsed(head, first):
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith(first):
        raise BadArchive(f"a record starts with {lines[0][:40]!r}")
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])


def parse(data):
    """A record's fields, with every length and digest it states checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise BadArchive("a record has no end of its header")
    fields = _parsed(head, "WARC/1.")
    length = int(fields["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BadArchive(f"a record of {len(rest)} bytes states {length}")
    block = rest[:length]
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise BadArchive("a block has another digest than stated")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        raise BadArchive("a block has no end of its HTTP header")
    stated = int(_parsed(http, "HTTP/1.")["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response":
        if len(payload) != stated or hashlib.sha256(payload).hexdigest() != digest:
            raise BadArchive("a payload has another length or digest than stated")
    elif kind != "revisit" or payload or not fields.get("WARC-Refers-To-Page"):
        raise BadArchive(f"a {kind} record with {len(payload)} bytes of payload")
    page, refers = fields["WARC-Page-ID"], fields.get("WARC-Refers-To-Page")
    return {
        "page_id": int(page) if page else None, "url": fields.get("WARC-Target-URI"), "payload_bytes": stated,
        "payload_digest": digest, "record_type": kind, "refers_to": int(refers) if refers else None, "payload": payload,
    }


def records(data):
    """The records of an archive's bytes, each its own frame. Plain archives without a dictionary do too."""
    import zstandard

    place, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        if len(data) < 8 + size:
            raise BadArchive("the dictionary is cut off")
        held = bytes(data[8:8 + size])
        if held[:4] == b"\x28\xb5\x2f\xfd":  # a dictionary may itself be compressed
            held = zstandard.ZstdDecompressor().decompress(held)
        dictionary, place = zstandard.ZstdCompressionDict(held), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while place < len(view):
        frame, content, start = reader.decompressobj(), [], place
        try:
            while not frame.eof:  # fed in steps, as what is left over is copied
                if place >= len(view):
                    raise BadArchive(f"the frame at byte {start} is cut off")
                content.append(frame.decompress(view[place:place + STEP]))
                place = min(place + STEP, len(view))
        except zstandard.ZstdError as error:
            raise BadArchive(f"a bad frame at byte {start}: {error}") from None
        place -= len(frame.unused_data)
        yield parse(b"".join(content))


def _write(folder, dictionary, archive_bytes):
    def run(batches):
        import zstandard

        store, base = fs.FileSystem.from_uri(folder)
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        writer = zstandard.ZstdCompressor(level=3, dict_data=held, write_checksum=True)
        start = struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary if dictionary else b""
        parts, size, count = [], 0, 0

        def close():
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(start)
                for part in parts:
                    out.write(part)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["archive", "records"])

        for batch in batches:
            pages, urls, payloads, digests, refers = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                data = record(pages[i].as_py(), urls[i].as_py(), payloads[i].as_buffer().to_pybytes(), digests[i].as_py(), refers[i].as_py())
                if parts and size + len(data) > archive_bytes:
                    yield close()
                    parts, size, count = [], 0, 0
                parts.append(writer.compress(data))
                size += len(data)
                count += 1
        if parts:
            yield close()

    return run


def _sample(pages):
    """The beginnings of at most DICTIONARY_SAMPLE pages: the hashes choose them before any text is fetched."""
    hashed = pages.select(F.xxhash64("page_id", "url").alias("h"), F.substring(text_of("html"), 1, SAMPLE_CHARACTERS).alias("html"))
    smallest = [row.h for row in hashed.select("h").orderBy("h").limit(DICTIONARY_SAMPLE).collect()]
    if not smallest:
        return []
    return [row.html for row in hashed.where(F.col("h") <= smallest[-1]).limit(DICTIONARY_SAMPLE).collect()]


def write_archives(pages, folder, archive_bytes=ARCHIVE_BYTES):
    """Write a record for each row of `pages` (page_id, url, html); returns the table (archive, records).

    `folder` is a URI that pyarrow can write to from every task and Spark can read. Of rows with equal
    payloads of at least `LEAST_REVISIT` bytes the one with the smallest page_id (null after all others, and
    the first record written of equal ids, here all of them) is a response and the others revisit it. A null html
    is an empty payload, a null url has no target.
    """
    spark = pages.sparkSession
    payload = F.encode(text_of("html"), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest")
    )
    large = rows.where(F.octet_length("payload") >= LEAST_REVISIT)
    firsts = written(
        large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first"),
        "firsts",
    )
    # few payloads recur; if they are many, the pages are joined by shuffle, which Spark splits where it is skewed
    if is_small(firsts, MOST_SENT_DIGESTS):
        firsts = F.broadcast(firsts)
    refers = F.when((F.octet_length("payload") >= LEAST_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    marked = rows.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    dictionary = train_dictionary([html.encode() for html in _sample(pages)])
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    return written(marked.mapInArrow(_write(folder, dictionary, archive_bytes), "archive string, records bigint"), "archives")


def _read(with_payload):
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                name = path.as_py().rsplit("/", 1)[-1]
                rows, size = [], 0
                for row in records(content.as_buffer()):
                    if not with_payload:
                        del row["payload"]
                    else:
                        size += len(row["payload"])
                    rows.append({"archive": name, **row})
                    if len(rows) == 4096 or size > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_arrow(with_payload))
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_arrow(with_payload))

    return run


def _arrow(with_payload):
    fields = [
        ("archive", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()),
    ]
    return pa.schema(fields + [("payload", pa.binary())] * with_payload)


def read_archives(spark, folder, archives=None, payload=False):
    """The records of the archives in a folder: archive, page_id, url, payload_bytes, payload_digest, record_type,
    refers_to and, if asked for, payload (empty for revisits).

    Frames, headers, lengths and digests are validated; a bad archive is an error that says what is wrong with
    it. `archives` (archive, ...) leaves others out.
    """
    schema = "archive string, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    rows = files.mapInArrow(_read(payload), schema + (", payload binary" if payload else ""))
    return rows if archives is None else rows.join(archives.select("archive"), "archive", "left_semi")
