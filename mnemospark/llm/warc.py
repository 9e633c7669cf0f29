"""Zstandard-compressed WARC archives: writing, and reading them back.

An archive starts with a skippable frame that holds the compression
dictionary; after it comes one Zstandard frame per record, so that a reader
decodes one record at a time. Writers and readers are tasks that stream: at
most one record and the dictionary sample are held at once.

Files get a fresh name at each task attempt and count only when the attempt's
manifest row is committed, so a retried or lost attempt leaves nothing that a
reader sees.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm._common import lookup, materialise, open_fs, text_id, trimmed
from mnemospark.storage import shared_path

#: The skippable frame that carries a dictionary (a fixed value of the format).
DICTIONARY_MAGIC = 0x184D2A5D
#: The frame of data (a fixed value of the format).
FRAME_MAGIC = 0xFD2FB528
#: The profile of a record whose payload another record holds (a fixed value of the format).
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes after which a writer starts the next archive.
ARCHIVE_BYTES = 64 << 20
#: The dictionary is trained on the first payloads of its archive, so many bytes at most.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 16 << 10
READ_BYTES = 1 << 20


class ArchiveError(ValueError):
    """A malformed archive or record."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one record; a revisit keeps the HTTP header and the digest, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        *([("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The header fields of one record with its checked block and payload."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ArchiveError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ArchiveError(f"malformed field {line[:60]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "content-length"):
        if name not in fields:
            raise ArchiveError(f"field {name} is missing")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError(f"{fields['warc-record-id']}: Content-Length is {length}; the block has {len(rest) - 4} bytes")
    block = rest[:length]
    if fields.get("warc-block-digest", "") != f"sha1:{payload_digest(block)}":
        raise ArchiveError(f"{fields['warc-record-id']}: the block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not sizes:
        raise ArchiveError(f"{fields['warc-record-id']}: the HTTP header has no length")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response" and (len(payload) != sizes[0] or payload_digest(payload) != digest):
        raise ArchiveError(f"{fields['warc-record-id']}: payload length or digest differs")
    if fields["warc-type"] == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ArchiveError(f"{fields['warc-record-id']}: a revisit names its response and holds no payload")
    return {"fields": fields, "payload": payload, "payload_bytes": sizes[0], "payload_digest": digest}


def dictionary_of(samples: list[bytes]) -> bytes:
    """A trained dictionary; none where the samples are too few or too small to train on."""
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


def _open_compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=data, write_checksum=True, write_content_size=True)


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write page_id, url, html, refers_to (null: a response) as archives; returns the committed manifest.

    Manifest: archive, n_records, size. Null html is an empty payload. A
    partition without rows writes nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)

        def rows() -> Iterator[tuple]:
            for b in batches:
                for page, url, html, first, revisit in zip(b.page_id, b.url, b.html, b.refers_to, b.revisit, strict=True):
                    yield (None if page is None else int(page), url, (html or "").encode(), None if first is None else int(first), bool(revisit))

        def write(first: list[tuple], more: Iterator[tuple]) -> pd.DataFrame:
            name = f"part-{uuid.uuid4().hex}.warc.zst"
            dictionary = dictionary_of([r[2][:65536] for r in first if r[2]])
            compressor, n, size, taken = _open_compressor(dictionary), 0, 0, 0
            with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                if dictionary:
                    size += out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                for source in (first, more):
                    for r in source:
                        size += out.write(compressor.compress(record(r[0], r[1], r[2], r[3], r[4])))
                        n, taken = n + 1, taken + len(r[2])
                        if source is more and taken >= archive_bytes:
                            break
            return pd.DataFrame({"archive": [f"{folder}/{name}"], "n_records": [n], "size": [size]})

        stream = rows()
        while True:
            first, held = [], 0
            for r in stream:
                first.append(r)
                held += len(r[2])
                if held >= SAMPLE_BYTES:
                    break
            if not first:
                return
            yield write(first, stream)

    return materialise(records.select(text_id("page_id").alias("page_id"), "url", "html", text_id("refers_to").alias("refers_to"), "revisit").mapInPandas(trimmed(run), "archive string, n_records long, size long"), "warc-manifest")


def read_stream(file) -> Iterator[dict]:
    """The records of one open archive: dictionary frame first (if any), then a frame per record."""
    buffer, ended = b"", False

    def fill(n: int) -> bytes:
        nonlocal buffer, ended
        while len(buffer) < n and not ended:
            more = file.read(READ_BYTES)
            ended = not more
            buffer += more
        return buffer[:n]

    dictionary = None
    head = fill(8)
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", head[4:])[0]
        if len(fill(8 + size)) < 8 + size:
            raise ArchiveError("the dictionary frame is cut short")
        dictionary = zstandard.ZstdCompressionDict(buffer[8 : 8 + size])
        buffer = buffer[8 + size :]
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while head := fill(4):
        if len(head) < 4 or struct.unpack("<I", head)[0] != FRAME_MAGIC:
            raise ArchiveError("a record's frame does not begin where the last one ended")
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if not fill(1):
                raise ArchiveError("a record's frame is cut short")
            parts.append(frame.decompress(buffer))
            buffer = frame.unused_data if frame.eof else b""
        yield parse_record(b"".join(parts))


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the manifest's archives.

    page_id, record_type, refers_to, payload_bytes, payload_digest, url and
    payload (null for a revisit); one task reads whole archives as streams.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "url", "payload"]
        of = lambda urn: pd.NA if urn is None or urn == "<urn:page:None>" else int(urn[10:-1])
        for batch in batches:
            for archive, n_records in zip(batch.archive, batch.n_records, strict=True):
                fs, path = open_fs(archive)
                rows, size, n = [], 0, 0
                with fs.open_input_stream(path, compression=None) as file:
                    for r in read_stream(file):
                        f, n = r["fields"], n + 1
                        response = f["warc-type"] == "response"
                        rows.append((of(f["warc-record-id"]), f["warc-type"], of(f.get("warc-refers-to")), r["payload_bytes"], r["payload_digest"], f.get("warc-target-uri"), r["payload"] if response else None))
                        size += len(r["payload"])
                        if size > (8 << 20):
                            yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows, size = [], 0
                if n != n_records:
                    raise ArchiveError(f"{archive}: {n} records; the manifest says {n_records}")
                if rows:
                    yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    spread = manifest.repartition(max(1, manifest.count()))  # an archive a task: its rows say nothing of its bytes
    return spread.mapInPandas(trimmed(run), "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, payload binary")


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html with refers_to and revisit.

    Of pages with equal payloads of at least least_bytes, the one with the
    smallest page_id is the response. Rows that repeat its id, and rows
    whose group has null ids only, are responses too.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    firsts = materialise(rows.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")), "digests")
    joined = lookup(rows, firsts, ["digest"], "n", ["page_id", "url"])
    revisit = (F.octet_length("html") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"))


def archive_pages(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) to archives in the shared folder and read them back.

    Returns read_archives()'s columns. An empty table gives no rows; other
    columns of pages are not read.
    """
    folder = shared_path(pages.sparkSession, "warc")
    return read_archives(write_archives(mark_revisits(pages, least_bytes), folder, archive_bytes))
