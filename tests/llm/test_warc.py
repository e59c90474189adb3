import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from lexloom.llm import warc
from lexloom.llm.common import new_path

PAGES = [(4, "http://a.example/", "<p>one</p>"), (2, "http://b.example/ x\n", "<p>one</p>"), (2, "http://b.example/ x\n", "<p>one</p>"), (6, None, None), (1, "u", ""), (None, "u", "<p>one</p>"), (None, "v", "only"), (8, "w", "é☃" * 100_000)]


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("copy", "first", "digest", "payload", "n", "refers_to")})
    manifest = warc.write_archives(warc.deduplicated(pages), new_path(spark, "t"))
    rows = warc.read_archives(manifest).collect()
    assert len(rows) == len(PAGES) and not any(r["error"] for r in rows)
    first = {}
    for page_id, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0])):
        first.setdefault((html or "").encode(), page_id)
    by_digest = {warc.payload_digest(k): (k, v) for k, v in first.items()}
    for r in rows:
        payload, smallest = by_digest[r["payload_digest"]]
        assert r["payload_bytes"] == len(payload)
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == payload and r["page_id"] == smallest and r["refers_to"] is None
        else:
            assert r["payload"] is None and r["refers_to"] == smallest
    assert sum(r["record_type"] == "response" for r in rows) == len(first)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(warc.deduplicated(pages), new_path(spark, "t"))).count() == 0


def test_least_bytes(spark):
    pages = spark.createDataFrame([(1, "", "ab"), (2, "", "ab"), (3, "", "abcdef"), (4, "", "abcdef")], "page_id long, url string, html string")
    got = {r["page_id"]: r["refers_to"] for r in warc.deduplicated(pages, 5).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


RECORDS = [warc.record(i, 1, f"http://x.example/{i}", (f"<html>page {i} " + "common words of all pages " * 20).encode(), None, "2000-01-01T00:00:00Z") for i in range(300)]


def test_dictionary_leads():
    data = warc.compress(RECORDS)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.DICTIONARY_MAGIC
    assert list(warc.frames(io.BytesIO(data), chunk=97)) == RECORDS
    with pytest.raises(zstandard.ZstdError):  # frames need the dictionary
        list(warc.frames(io.BytesIO(data[8 + size :])))
    plain = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size], max_output_size=1 << 20)
    raw = struct.pack("<II", warc.DICTIONARY_MAGIC, len(plain)) + plain + data[8 + size :]
    assert list(warc.frames(io.BytesIO(raw))) == RECORDS  # a dictionary that isn't compressed
    skipped = data[: 8 + size] + struct.pack("<II", 0x184D2A50, 3) + b"abc" + data[8 + size :]
    assert list(warc.frames(io.BytesIO(skipped))) == RECORDS


def test_few_records_need_no_dictionary():
    assert list(warc.frames(io.BytesIO(warc.compress(RECORDS[:1])))) == RECORDS[:1]


@pytest.mark.parametrize(
    ("change", "said"),
    [
        (lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), "version"),
        (lambda r: r.replace(b"WARC-Date: 2000-01-01T00:00:00Z\r\n", b""), "missing"),
        (lambda r: r.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9"), "bytes"),
        (lambda r: r[:-4], "bytes"),
        (lambda r: r.replace(b"page 5 ", b"page 6 "), "digest"),
        (lambda r: r.replace(b"<urn:page:5>", b"<urn:other>"), "record id"),
        (lambda r: r.split(b"\r\n\r\n")[0], "does not end"),
    ],
)
def test_validation(change, said):
    with pytest.raises(ValueError, match=said):
        warc.parse(change(RECORDS[5]))


def test_broken_archives_are_reported(spark, tmp_path):
    good = warc.compress(RECORDS)
    bad = warc.compress([RECORDS[0], RECORDS[1].replace(b"page 1 ", b"page 2 "), RECORDS[2]])
    (tmp_path / "a").write_bytes(good[:-5])
    (tmp_path / "b").write_bytes(bad)
    paths = spark.createDataFrame([(f"file://{tmp_path}/{x}",) for x in "ab"], "path string")
    rows = warc.read_archives(paths, payloads=False).collect()
    a, b = ([r for r in rows if r["archive"].endswith(x)] for x in "ab")
    assert len(a) == 300 and [r["error"] for r in a if r["error"]] == ["unreadable from here on: the archive ends within a frame"]
    assert [bool(r["error"]) for r in b] == [False, True, False]
