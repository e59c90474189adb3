"""WARC archives compressed with Zstandard: writer and reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, then
has one frame per record. The reader loads the dictionary, decodes frame by frame, and checks
the headers, the block's length and end, and the payload's length and SHA-1.

Archives go to the shared folder through pyarrow's file systems. A task names its files after
its attempt, and the manifest, written by Spark's commit protocol, lists those of the
attempts that counted; leftovers of lost executors are never read.

Cases: a null html is the empty payload; a null url leaves the target header out; pages without
an id come after all others, and their id reads back as null; of repeated rows (same id,
same payload) the first is the response and the others revisit that id; an empty table gives
no archive and no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.common import new_path, staged, table

DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Raw bytes after which a task starts its next archive, and what a dictionary is trained on.
ARCHIVE_BYTES, DICTIONARY_BYTES, DICTIONARY_SAMPLES = 16 << 20, 32 << 10, 256
MANIFEST = "path string, records long, raw_bytes long, file_bytes long"
RECORDS = "archive string, record_type string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string, payload binary, error string"
RECORDS_ARROW = pa.schema([(c, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for c, t in (x.split() for x in RECORDS.split(", "))])
NO_ID = -(2**63)


# --- records -------------------------------------------------------------------------------


def urn(page_id: int, copy: int = 1) -> str:
    return f"<urn:page:{'' if page_id == NO_ID else page_id}{f':{copy}' if copy > 1 else ''}>"


def page_of(value: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d*)(?::\d+)?>", value)
    if not m:
        raise ValueError(f"not a record id: {value}")
    return int(m[1]) if m[1] else None


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, copy: int, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, whose block has the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {urn(page_id, copy)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head[4:4] = [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(lines: list[str]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line: {line[:80]!r}")
        found[name.strip().lower()] = value.strip()
    return found


def parse(data: bytes) -> dict:
    """The fields of one record; a ValueError says what is wrong with it."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("the header does not end")
    lines = data[:end].decode().split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError(f"not a WARC version: {lines[0][:40]!r}")
    head = headers(lines[1:])
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - head.keys():
        raise ValueError(f"headers missing: {sorted(missing)}")
    if not head["content-length"].isdigit():
        raise ValueError("Content-Length is not a number")
    start, size = end + 4, int(head["content-length"])
    block = data[start : start + size]
    if len(block) != size or data[start + size :] != b"\r\n\r\n":
        raise ValueError(f"the block has not the {size} bytes of its header")
    kind, http_end = head["warc-type"], block.find(b"\r\n\r\n")
    if kind not in ("response", "revisit"):
        return {"record_type": kind, "url": head.get("warc-target-uri"), "payload": block, "payload_bytes": size}
    if http_end < 0:
        raise ValueError("the HTTP header does not end")
    http = headers(block[:http_end].decode().split("\r\n")[1:])
    payload, digest = block[http_end + 4 :], head.get("warc-payload-digest", "").removeprefix("sha1:")
    if not http.get("content-length", "").isdigit():
        raise ValueError("the HTTP header has no length")
    if kind == "response" and (len(payload) != int(http["content-length"]) or payload_digest(payload) != digest):
        raise ValueError("the payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in head):
        raise ValueError("a revisit has a payload or refers to nothing")
    return {
        "record_type": kind,
        "page_id": page_of(head["warc-record-id"]),
        "refers_to": page_of(head["warc-refers-to"]) if kind == "revisit" else None,
        "url": head.get("warc-target-uri"),
        "payload_bytes": int(http["content-length"]),
        "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


# --- archives ------------------------------------------------------------------------------


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on records of this archive; None where they are too few or too alike."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r[: 32 << 10] for r in records[:DICTIONARY_SAMPLES]], k=256, d=8)
    except zstandard.ZstdError:
        return None


def compress(records: list[bytes], level: int = 3) -> bytes:
    found = dictionary(records)
    parts = []
    if found is not None:
        raw = zstandard.ZstdCompressor(level=level).compress(found.as_bytes())
        parts.append(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=found, write_checksum=True, write_content_size=True)
    return b"".join(parts + [compressor.compress(r) for r in records])


def frames(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The decoded frames of an archive, holding one record and one chunk at a time."""
    held, decoder, first = b"", zstandard.ZstdDecompressor(), True

    def more(size: int) -> bytes:
        nonlocal held
        while len(held) < size and (got := stream.read(max(chunk, size - len(held)))):
            held += got
        return held

    while more(8):
        if len(held) < 8:
            raise ValueError("the archive ends within a frame")
        magic, size = struct.unpack("<II", held[:8])
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if len(more(8 + size)) < 8 + size:
                raise ValueError("the archive ends within a skippable frame")
            body, held = held[8 : 8 + size], held[8 + size :]
            if first and magic == DICTIONARY_MAGIC:
                if body[:4] == ZSTD_MAGIC:
                    body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 27)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            first = False
            continue
        first, frame, out = False, decoder.decompressobj(), []
        while not frame.eof:
            if not more(1):
                raise ValueError("the archive ends within a frame")
            given, held = held, b""
            out.append(frame.decompress(given))
        held = frame.unused_data
        yield b"".join(out)


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_archives(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes ``pages`` (page_id, copy, url, payload, refers_to) to ``folder``; the manifest of the archives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, (store, path) = TaskContext.get(), file_system(folder)
        store.create_dir(path, recursive=True)
        held, size, count = [], 0, 0

        def flush() -> pd.DataFrame:
            nonlocal held, size, count
            name, data = f"{task.partitionId():06d}-{task.taskAttemptId()}-{count:05d}.warc.zst", compress(held)
            with store.open_output_stream(f"{path}/{name}") as out:
                out.write(data)
            row = pd.DataFrame({"path": [f"{folder}/{name}"], "records": [len(held)], "raw_bytes": [size], "file_bytes": [len(data)]})
            held, size, count = [], 0, count + 1
            return row

        for pdf in batches:
            refers = pdf["refers_to"].astype(object).where(pdf["refers_to"].notna(), None)
            for page_id, copy, url, payload, to in zip(pdf["page_id"], pdf["copy"], pdf["url"], pdf["payload"], refers, strict=True):
                held.append(record(page_id, copy, url, bytes(payload), None if to is None else int(to), date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return staged(pages.mapInPandas(run, MANIFEST), "manifest")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives whose paths ``archives`` has; ``error`` says what is wrong with one."""
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rows(path: str) -> Iterator[dict]:
        store, name = file_system(path)
        with store.open_input_stream(name) as stream:
            try:
                for data in frames(stream):
                    try:
                        yield parse(data)
                    except ValueError as e:
                        yield {"error": str(e)}
            except (ValueError, zstandard.ZstdError) as e:
                yield {"error": f"unreadable from here on: {e}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                for row in rows(path):
                    size += len(row.get("payload") or b"")
                    held.append(row | {"archive": path} | ({} if payloads else {"payload": None}))
                    if len(held) >= 4096 or payloads and size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, RECORDS_ARROW)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, RECORDS_ARROW)

    return archives.select("path").repartition(n, "path").mapInArrow(run, RECORDS)


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) ready for :func:`write_archives`.

    Of equal payloads of ``least_bytes`` or more the smallest id is the response. Only ids and
    digests meet by digest, so a payload that a third of all pages share moves no text there.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    key = F.coalesce("page_id", F.lit(NO_ID).cast("long"))
    rows = pages.select(key.alias("page_id"), "url", payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"))
    order = lambda c: F.when(F.col(c) == NO_ID, F.lit(2**63 - 1)).otherwise(F.col(c))  # noqa: E731  no id: after all others
    copies = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    groups = copies.groupBy("digest").agg(F.sum("n").alias("n"), F.min_by("page_id", order("page_id")).alias("first")).where("n > 1").drop("n")
    decided = copies.join(groups, "digest").select("digest", "page_id", "first")
    by_row = W.partitionBy("page_id", "digest").orderBy("url")
    out = rows.join(decided, ["page_id", "digest"], "left").withColumn("copy", F.row_number().over(by_row))
    first = F.col("first").isNull() | (F.col("first") == F.col("page_id")) & (F.col("copy") == 1)
    return out.select("page_id", "copy", "url", "payload", F.when(~first, F.col("first")).alias("refers_to"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record and read back."""
    manifest = write_archives(deduplicated(table(spark, sf_dir, "pages")), new_path(spark, "archives"))
    records = read_archives(manifest, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
