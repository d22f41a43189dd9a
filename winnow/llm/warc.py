"""WARC archives compressed record by record with a dictionary each archive carries."""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_map, narrow, null_safe

# Uncompressed bytes after which an archive is closed; an archive is one file.
ARCHIVE_BYTES = 16_000_000
DICTIONARY_BYTES = 32_768
# Bytes of an archive's records, spread evenly, that its dictionary is built from.
TRAINING_BYTES = 3_200_000
LEVEL = 6

# Magic numbers of skippable frames; the first marks a dictionary in front.
DICTIONARY_MAGIC = 0x184D2A5D
PADDING_MAGIC = 0x184D2A50
# An empty skippable frame, all of it below 80 hex: what the text sink puts after each row.
PADDING = struct.pack("<II", PADDING_MAGIC, 0).decode("ascii")

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit holds the HTTP headers alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
    ]
    if url:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    else:
        block += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, payload digest, record type, refers_to); checks the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")

    def page(field):
        text = fields.get(field, "<urn:page:>")[len("<urn:page:"):-1]
        return int(text) if text else None

    return page("WARC-Record-ID"), length, digest, kind, page("WARC-Refers-To")


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES, budget: int = TRAINING_BYTES) -> bytes:
    """A dictionary trained on records of the archive, evenly thinned to a byte budget; where
    there are too few to train on, the bytes of the records themselves."""
    total = sum(map(len, records))
    step = max(1, -(-total // budget))
    sample = records[::step]
    try:
        return zstandard.train_dictionary(size, sample, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-size:]


def archive(records: list[bytes], level: int = LEVEL) -> bytes:
    """The file: the dictionary in a skippable frame, then one frame per record."""
    raw = build_dictionary(records)
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw, *map(packer.compress, records)])


def records_of(content: bytes):
    """The records of an archive, one by one."""
    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary in front")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8:8 + size]))
    rest = memoryview(content)[8 + size:]
    while len(rest):
        magic = struct.unpack_from("<I", rest)[0]
        if magic >> 4 == PADDING_MAGIC >> 4:
            rest = rest[8 + struct.unpack_from("<I", rest, 4)[0]:]
            continue
        frame = unpacker.decompressobj()
        taken, raw = 0, []
        while not frame.eof:
            raw.append(frame.decompress(rest[taken:taken + 65536]))
            taken += 65536
        rest = rest[min(taken, len(rest)) - len(frame.unused_data):]
        yield b"".join(raw)


def _pack(archive_bytes):
    def run(batches):
        held, size = [], 0
        for b in batches:
            for page, url, html, refers in zip(*[b.column(n).to_pylist() for n in ("page_id", "url", "html", "refers_to")]):
                raw = record(page, url, (html or "").encode(), refers)
                held.append(raw)
                size += len(raw)
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"archive": [archive(held)]})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"archive": [archive(held)]})

    return run


def _unpack(batches):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    for b in batches:
        for content in b.column("content").to_pylist():
            columns = list(zip(*map(parse, records_of(content)))) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def write(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id",
          url_col: str = "url", html_col: str = "html") -> None:
    """Write a record per page into archives under `path`, through Spark's text sink, so that only
    whole files of finished tasks appear. One row is one archive and one file; the line
    separator after it is an empty skippable frame.

    Of pages with equal payloads of at least `min_bytes`, the one with the smallest page_id is a
    response and the others revisit it, pages without id too; payloads of pages without id alone are responses, as
    are several rows with the smallest page_id. Null html is an empty payload. An empty table leaves a folder without archives."""
    rows = narrow(pages, page_id=id_col, url=url_col, html=html_col).select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "digest", F.unhex(F.sha2("html", 256)))
    keys = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = keys.join(first, "digest").where("page_id IS DISTINCT FROM refers_to AND refers_to IS NOT NULL").distinct().select(
        F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to")
    # by page, not by payload: a payload that a third of all pages share is spread evenly
    joined = rows.join(again, null_safe(rows, again, {"page_id": "_page", "digest": "_digest"}), "left")
    packed = arrow_map(joined.select("page_id", "url", "html", "refers_to"), _pack(archive_bytes), "archive binary")
    packed.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", PADDING).option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to. A
    response whose payload does not fit its digest fails the read."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return arrow_map(files, _unpack, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
