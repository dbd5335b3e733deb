"""Archives by round trip, and what a damaged one says."""

import hashlib
import struct

import pytest
import zstandard

from gridprep.llm import warc
from gridprep.llm.tables import shared_folder

SCHEMA = "page_id long, url string, html string"
LARGE = "é" * 60
ROWS = [(1, "http://a/", LARGE), (2, None, LARGE), (3, "a\r\nb", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", "\r\n\r\n" * 40),
        (8, "u", "x" * 3_000_000), (None, "u", LARGE), (2, "again", LARGE), (9, "u", "\r\n\r\n" * 40)]


def test_round_trip(spark):
    folder = shared_folder(spark, "warc")
    archives = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA), folder, 1 << 20)
    rows = warc.read_archives(spark, folder, archives, payload=True).collect()
    assert archives.agg({"records": "sum"}).head()[0] == len(rows) == len(ROWS)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)
    first = {LARGE: 1, "\r\n\r\n" * 40: 7}
    want = []
    for page, _, html in ROWS:
        payload = (html or "").encode()
        refers = first.get(html) if first.get(html) != page else None
        want.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if refers else "response", refers))
    assert got == sorted(want, key=str)
    html = {r.page_id: r.payload.decode() for r in rows if r.record_type == "response"}
    assert html == {1: LARGE, 3: "small", 4: "small", 5: "", 6: "", 7: "\r\n\r\n" * 40, 8: "x" * 3_000_000}
    assert {r.url for r in rows if r.page_id == 3} == {"a%0D%0Ab"}


def test_pages_with_a_dictionary(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    folder = shared_folder(spark, "warc")
    archives = warc.write_archives(pages, folder)
    data = bytes(spark.read.format("binaryFile").load(folder).head().content)
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_FRAME
    assert warc.read_archives(spark, folder, archives).count() == pages.count()
    # a file that no finished task has named is not read
    left_over = archives.limit(0)
    assert warc.read_archives(spark, folder, left_over).count() == 0


def test_empty_table(spark):
    folder = shared_folder(spark, "warc")
    archives = warc.write_archives(spark.createDataFrame([], SCHEMA), folder)
    assert archives.count() == 0 and warc.read_archives(spark, folder, archives).count() == 0


def test_damage_is_named():
    payload = b"hello world"
    record = warc.record(1, "u", payload, hashlib.sha256(payload).hexdigest(), None)
    frame = zstandard.ZstdCompressor(write_checksum=True)
    assert [r["payload"] for r in warc.records(frame.compress(record) * 3)] == [payload] * 3
    bad = {
        "cut off": frame.compress(record)[:-5],
        "bad frame": b"\x00" * 40,
        "dictionary": struct.pack("<II", warc.DICTIONARY_FRAME, 1000) + b"xy",
        "states": frame.compress(record.replace(b"Content-Length: 11", b"Content-Length: 12").replace(b"hello", b"hell")),
        "digest": frame.compress(record.replace(b"hello", b"jello")),
        "starts with": frame.compress(b"nothing\r\n\r\n"),
        "no end": frame.compress(b"nothing"),
    }
    for message, data in bad.items():
        with pytest.raises(warc.BadArchive, match=message):
            list(warc.records(data))
