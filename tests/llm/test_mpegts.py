"""Transport streams: exact round trips, table and counter checks, damaged input."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemospark.llm import mpegts
from mnemospark.llm.mpegts import PACKET, StreamError, mux, padded_payload, parse


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=0, max_size=9000), st.integers(1, 4000), st.integers(1, 9))
def test_round_trip(payload, unit, per_point):
    unit = max(unit, len(payload) // 40 + 1)
    s = parse(mux(payload, unit, per_point))
    assert s.payload == payload and s.continuity_errors == 0
    assert [u[1] for u in s.units] == list(range(0, len(payload), unit))
    assert [u[3] for u in s.units] == [i % per_point == 0 for i in range(len(s.units))]
    assert [u[0] for u in s.units] == [90000 + 3600 * i for i in range(len(s.units))]


def test_every_size_of_last_packet():
    for n in range(1, 400):
        assert parse(mux(bytes(range(256)) * 2, 3072)).payload == bytes(range(256)) * 2
        assert parse(mux(b"x" * n)).payload == b"x" * n


def stream():
    return bytearray(mux(bytes(range(256)) * 100))


def test_continuity_and_duplicates():
    data = stream()
    own = [i for i in range(0, len(data), PACKET) if data[i + 1] & 0x1F == 1]
    gap = data[: own[5]] + data[own[5] + PACKET :]
    assert parse(bytes(gap)).continuity_errors == 1
    twice = data[: own[5] + PACKET] + data[own[5] :]
    s = parse(bytes(twice))
    assert (s.duplicates, s.continuity_errors, s.payload) == (1, 0, bytes(range(256)) * 100)


def test_sections_that_share_packets():
    """A section that ends where the next begins, after the pointer, and two in one packet."""

    def section(table: int, body: bytes) -> bytes:
        head = bytes([table]) + (0xB000 | len(body) + 4).to_bytes(2, "big")
        return head + body + mpegts.section_crc(head + body).to_bytes(4, "big")

    def packet(begins: int | None, data: bytes, counter: int) -> bytes:
        data = (b"" if begins is None else bytes([begins])) + data
        return bytes([0x47, 0x40 if begins is not None else 0, 0x20, 0x10 | counter]) + data.ljust(184, b"\xff")

    a, b, c = section(2, b"a" * 300), section(2, b"b" * 20), section(2, b"c" * 20)
    rest = a[183:]
    data = packet(0, a[:183], 0) + packet(len(rest), rest + b + c, 1)
    got = list(mpegts._sections(np.frombuffer(data, np.uint8).reshape(-1, PACKET), 0x20, 2))
    assert got == [a, b, c]


def test_malformed():
    data = stream()
    for change in (lambda d: d[:-1], lambda d: b"\x00" + d[1:], lambda d: d[:8] + b"\xff" + d[9:], lambda d: d[PACKET * 2 :], lambda d: d[:PACKET] * 2):
        with pytest.raises(StreamError):
            out = parse(bytes(change(data)))
            if out.payload:  # the tables come again at the next access point
                raise StreamError
    assert mpegts.section_crc(b"123456789") == 0x0376E6E7


def test_operator(spark):
    texts = [(1, "héllo"), (2, ""), (3, None), (None, "x" * 192), (5, "y" * 200_000), (6, "héllo"), (6, "héllo")]
    docs = spark.createDataFrame([(i, t, "clash", b"m") for i, t in texts], "doc_id long, text string, feature string, media binary")
    stored = mpegts.store(docs)
    got = {(r.doc_id, r.n_bytes): r for r in mpegts.digest(stored).collect()}
    for i, t in texts:
        n, payload = padded_payload(t or "")
        r = got[i, n]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert len(payload) % 192 == 0 and len(payload) > 0 and r.media_bytes % PACKET == 0 and r.continuity_errors == 0 and r.index_holds
    units = mpegts.access_units(stored).where("doc_id = 5").orderBy("unit").collect()
    assert len(units) == -(-200064 // mpegts.UNIT) and units[0].random_access and not units[1].random_access
    assert np.all(np.diff([u.pts for u in units]) == 3600)
    assert mpegts.digest(mpegts.store(docs.limit(0))).collect() == []
