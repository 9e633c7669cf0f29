"""Archives: round trips, revisits and malformed input."""

import base64
import hashlib
import io
import struct

import pytest
import zstandard

from mnemospark.llm.warc import ArchiveError, DICTIONARY_MAGIC, archive_pages, dictionary_of, parse_record, read_stream, record

ROWS = [(1, "http://a/x y", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "v", "z" * 3_000_000), (None, "n", "only"), (6, "w", "q\r\n\r\nq"), (6, "w", "q\r\n\r\nq")]


def test_round_trip_and_revisits(spark):
    rows = ROWS + [(100 + k, f"http://h/{k}", "hot page") for k in range(200)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = archive_pages(pages, archive_bytes=1000).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    by_id = {r.page_id: r for r in got}
    for i, _, html in rows:
        r, payload = by_id[i], (html or "").encode()
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        at = first.get(html or "")
        assert (r.record_type, r.refers_to) == (("response", None) if i == at or i is None else ("revisit", at))
        if r.record_type == "response":
            assert bytes(r.payload) == payload


def test_empty(spark):
    assert archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def archive(dictionary, records):
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    head = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""
    return head + b"".join(zstandard.ZstdCompressor(dict_data=data).compress(r) for r in records)


def test_dictionary_frame_is_loaded():
    import random

    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(300)]
    pages = [" ".join(rng.choice(vocabulary) for _ in range(200)).encode() for _ in range(200)]
    dictionary = dictionary_of(pages)
    assert dictionary
    records = [record(i, "u", p, None, False) for i, p in enumerate(pages)]
    assert [r["payload"] for r in read_stream(io.BytesIO(archive(dictionary, records)))] == pages
    with pytest.raises(zstandard.ZstdError):
        list(read_stream(io.BytesIO(archive(dictionary, records)[8 + len(dictionary) :])))


def test_malformed():
    good = record(1, "u", b"abc", None, False)
    assert parse_record(good)["payload"] == b"abc"
    for bad in (good[:-1], good.replace(b"abc", b"abd"), b"nothing", good.replace(b"WARC-Type", b"Other"), good.replace(b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises(ArchiveError):
            parse_record(bad)
    whole = archive(b"", [good, good])
    with pytest.raises(ArchiveError):
        list(read_stream(io.BytesIO(whole[:-3])))
    with pytest.raises(ArchiveError):
        list(read_stream(io.BytesIO(whole + b"xxxx")))
