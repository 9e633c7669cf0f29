"""Media columns: MPEG transport streams in a binary column.

`store` writes each payload as one single-program transport stream: program
tables (PAT and PMT) before every random-access point, then the payload as
private-data elementary packets of UNIT bytes, each with a presentation
timestamp. `parse` reads a stream of any such layout: it checks sync bytes and
section CRCs, follows the PAT to the PMT and the PMT to the elementary
streams, checks continuity counters, reassembles elementary packets across
transport packets, and lists every access unit with its timestamp, place and
random-access flag. Packets of a stream are handled as one numpy array.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm._common import materialise, text_id, trimmed, whole_ids

#: Fixed values of the format.
PACKET, SYNC, NULL_PID, PAT_PID = 188, 0x47, 0x1FFF, 0x0000
PRIVATE_STREAM_TYPE, PRIVATE_STREAM_ID = 0x06, 0xBD
CLOCK_HZ = 90_000
#: What the writer chooses.
PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
UNIT, UNIT_TICKS, UNITS_PER_ACCESS_POINT, FIRST_PTS = 16 * 192, 3600, 8, CLOCK_HZ
PAD = 192
GROUP_BYTES = 4 << 20


class StreamError(ValueError):
    """A transport stream that cannot be parsed."""


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
        table.append(crc & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32 of program tables (most significant bit first, no final inversion)."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ byte]
    return crc


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    packet = np.full(PACKET, 0xFF, np.uint8)
    data = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    packet[: len(data)] = np.frombuffer(data, np.uint8)
    return packet


_PAT = _table_packet(PAT_PID, _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _stamp(pts: int) -> bytes:
    """A 33-bit timestamp in its five bytes with marker bits."""
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def mux(payload: bytes, unit: int = UNIT, units_per_access_point: int = UNITS_PER_ACCESS_POINT) -> bytes:
    """The payload as a transport stream; an empty payload is a stream of tables only."""
    parts: list[np.ndarray] = [] if payload else [_PAT, _PMT]
    counter = tables = 0
    for i, start in enumerate(range(0, len(payload), unit)):
        pts = (FIRST_PTS + i * UNIT_TICKS) % (1 << 33)
        body = payload[start : start + unit]
        access = i % units_per_access_point == 0
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_ID]) + (len(body) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(pts) + body
        adaptation = b""
        if access:
            for table in (_PAT, _PMT):
                packet = table.copy()
                packet[3] = 0x10 | tables & 15
                parts.append(packet)
            tables += 1
            clock = (pts - CLOCK_HZ // 10) % (1 << 33)
            adaptation = b"\x07\x50" + (clock << 15 | 0x7E00).to_bytes(6, "big")
        first = min(len(pes), PACKET - 4 - len(adaptation))
        count = 1 + -(-(len(pes) - first) // (PACKET - 4))
        data = np.frombuffer(pes, np.uint8)
        packets = np.full((count, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(count)) & 15
        counter = (counter + count) & 15
        if adaptation:
            packets[0, 3] |= 0x20
            packets[0, 4 : 4 + len(adaptation)] = np.frombuffer(adaptation, np.uint8)
        packets[0, PACKET - first :] = data[:first]
        if count > 2:
            packets[1:-1, 4:] = data[first : first + (count - 2) * (PACKET - 4)].reshape(-1, PACKET - 4)
        left = len(pes) - first - max(0, count - 2) * (PACKET - 4) if count > 1 else first
        if count > 1:
            packets[-1, PACKET - left :] = data[len(pes) - left :]
        stuffed = PACKET - 4 - left
        if stuffed and (count > 1 or stuffed > len(adaptation)):  # the last packet's room is filled in its adaptation field
            packets[-1, 3] |= 0x20
            packets[-1, 4] = stuffed - 1
            if stuffed > 1 and not (count == 1 and adaptation):
                packets[-1, 5] = 0
        parts.append(packets.reshape(-1))
    return np.concatenate(parts).tobytes()


@dataclass
class Stream:
    """What `parse` finds in the first program's first elementary stream."""

    payload: bytes = b""
    programs: dict[int, int] = field(default_factory=dict)
    streams: list[tuple[int, int]] = field(default_factory=list)  # (stream type, PID)
    packets: int = 0
    continuity_errors: int = 0
    duplicates: int = 0
    units: list[tuple[int | None, int, int, bool]] = field(default_factory=list)  # (pts, payload offset, packet, random access)


def _payload_starts(packets: np.ndarray) -> np.ndarray:
    """Where each packet's payload begins (188: it has none)."""
    control = packets[:, 3] >> 4 & 3
    start = np.where(control & 2, 5 + packets[:, 4].astype(np.int32), 4)
    if (start > PACKET).any():
        raise StreamError("an adaptation field is longer than its packet")
    return np.where(control & 1, start, PACKET)


def _sections(packets: np.ndarray, pid: int, table_id: int) -> Iterator[bytes]:
    """The checked sections of a table, several in a packet or over several packets; repeats once.

    A packet that begins a section says where: what comes before that place
    ends the section of the packets before it.
    """
    own = packets[((packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]) == pid]
    seen: set[bytes] = set()
    pending: bytes | None = None  # None: nothing has begun yet

    def whole() -> Iterator[bytes]:
        nonlocal pending
        while pending is not None and len(pending) >= 3 and pending[0] != 0xFF:
            size = 3 + (int.from_bytes(pending[1:3], "big") & 0x0FFF)
            if len(pending) < size:
                return
            section, pending = pending[:size], pending[size:]
            if section in seen:
                continue
            seen.add(section)
            if section_crc(section) != 0:
                raise StreamError(f"the CRC of table {table_id} is wrong")
            if section[0] == table_id:
                yield section

    for packet, start in zip(own, _payload_starts(own), strict=True):
        data = packet[start:].tobytes()
        if packet[1] & 0x40 and data:
            if pending is not None:
                pending += data[1 : 1 + data[0]]
                yield from whole()
            pending = data[1 + data[0] :]
        elif pending is not None:
            pending += data
        yield from whole()


def parse(media: bytes) -> Stream:
    """Demultiplex a transport stream; a StreamError names what is malformed.

    Counter gaps are counted, not fatal: the packets that are there are
    joined. A packet that repeats its predecessor's counter and bytes is
    skipped as a duplicate.
    """
    if len(media) % PACKET:
        raise StreamError("the length is not a multiple of 188")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    out = Stream(packets=len(packets))
    if not len(packets):
        return out
    if (packets[:, 0] != SYNC).any():
        raise StreamError("a packet lacks its sync byte")
    if (packets[:, 1] & 0x80).any():
        raise StreamError("a packet is marked as damaged")
    for section in _sections(packets, PAT_PID, 0x00):
        for k in range(8, len(section) - 4, 4):
            if number := int.from_bytes(section[k : k + 2], "big"):
                out.programs[number] = int.from_bytes(section[k + 2 : k + 4], "big") & 0x1FFF
    if not out.programs:
        raise StreamError("no program association table")
    for pmt_pid in out.programs.values():
        for section in _sections(packets, pmt_pid, 0x02):
            k = 12 + (int.from_bytes(section[10:12], "big") & 0x0FFF)
            while k < len(section) - 4:
                entry = (section[k], int.from_bytes(section[k + 1 : k + 3], "big") & 0x1FFF)
                if entry not in out.streams:
                    out.streams.append(entry)
                k += 5 + (int.from_bytes(section[k + 3 : k + 5], "big") & 0x0FFF)
    if not out.streams:
        raise StreamError("no program map table")
    at = np.flatnonzero(((packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]) == out.streams[0][1])
    own = packets[at]
    if not len(own):
        return out
    starts = _payload_starts(own)
    flags = np.where((own[:, 3] & 0x20 > 0) & (own[:, 4] > 0), own[:, 5], 0)
    counter, carries = own[:, 3] & 15, own[:, 3] & 0x10 > 0
    same = np.concatenate(([False], (counter[1:] == counter[:-1]) & carries[1:] & (own[1:, 4:] == own[:-1, 4:]).all(axis=1)))
    out.duplicates = int(same.sum())
    own, at, starts, flags, counter, carries = (x[~same] for x in (own, at, starts, flags, counter, carries))
    expected = (counter[:-1] + carries[1:]) & 15
    out.continuity_errors = int(((counter[1:] != expected) & (flags[1:] & 0x80 == 0)).sum())
    mask = np.arange(PACKET) >= starts[:, None]
    joined, sizes = own[mask], PACKET - starts
    offsets = np.cumsum(sizes) - sizes
    heads = np.flatnonzero(own[:, 1] & 0x40)
    bounds = [*offsets[heads].tolist(), len(joined)]
    body, done = [], 0
    for k, head in enumerate(heads.tolist()):
        pes = joined[bounds[k] : bounds[k + 1]].tobytes()
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
            raise StreamError("an elementary packet lacks its start code")
        size = int.from_bytes(pes[4:6], "big")
        if size and len(pes) < 6 + size and not out.continuity_errors:
            raise StreamError("an elementary packet is cut short")
        pts = None
        if pes[7] & 0x80:
            s = pes[9:14]
            pts = (s[0] & 0x0E) << 29 | s[1] << 22 | (s[2] & 0xFE) << 14 | s[3] << 7 | s[4] >> 1
        data = pes[9 + pes[8] : 6 + size if size else len(pes)]
        out.units.append((pts, done, int(at[head]), bool(flags[head] & 0x40)))
        body.append(data)
        done += len(data)
    out.payload = b"".join(body)
    return out


def feature(stream: Stream) -> str:
    """A fingerprint of structure and samples: programs, units, access points, clock range, mean and spread."""
    samples = np.frombuffer(stream.payload, np.uint8)
    stamps = [u[0] for u in stream.units if u[0] is not None]
    mean, spread = (float(samples.mean()), float(samples.std())) if len(samples) else (0.0, 0.0)
    return (
        f"programs={len(stream.programs)};packets={stream.packets};units={len(stream.units)};access_points={sum(u[3] for u in stream.units)};"
        f"pts={min(stamps, default=0)}-{max(stamps, default=0)};continuity_errors={stream.continuity_errors};mean={mean:.4f};spread={spread:.4f}"
    )


def padded_payload(text: str) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes with spaces up to a positive multiple of PAD."""
    data = text.encode()
    return len(data), data + b" " * (-len(data) % PAD if data else PAD)


def _slices(batch: pd.DataFrame, column: str) -> Iterator[pd.DataFrame]:
    start = held = 0
    for i, value in enumerate(batch[column]):
        held += len(value or b"")
        if held >= GROUP_BYTES:
            yield batch.iloc[start : i + 1]
            start, held = i + 1, 0
    if start < len(batch):
        yield batch.iloc[start:]


_INDEX = "pts array<long>, payload_offsets array<long>, packets array<long>, random_access array<boolean>"


def _index(units: list[tuple]) -> tuple[list, list, list, list]:
    return tuple([u[k] for u in units] for k in range(4))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media and the index of its access units, in a table in the shared folder.

    Each text (null: empty) is a transport stream. The index has, for each
    unit, its timestamp, where it begins in the payload and among the packets,
    and whether a decoder can begin there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["pts", "payload_offsets", "packets", "random_access"]
        for batch in batches:
            for part in _slices(batch, "text"):
                rows = [padded_payload(t) for t in part.text]
                media = [mux(p) for _, p in rows]
                index = [_index(parse(m).units) for m in media]
                yield pd.DataFrame({"doc_id": whole_ids(part.doc_id), "n_bytes": [n for n, _ in rows], "media": media} | {c: [x[k] for x in index] for k, c in enumerate(names)})

    texts = docs.select(text_id(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return materialise(texts.mapInPandas(trimmed(run), "doc_id long, n_bytes long, media binary, " + _INDEX), "media")


def digest(stored: DataFrame) -> DataFrame:
    """Read each stored stream back: sizes, digests and features of payload and media.

    index_holds: the stored index of access units is the one the stream has.
    Null media counts as an empty stream.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            rows = []
            for n, media, *index in zip(batch.n_bytes, batch.media, batch.pts, batch.payload_offsets, batch.packets, batch.random_access, strict=True):
                media = media or b""
                s = parse(media)
                p = s.payload
                holds = all(x is not None and list(x) == y for x, y in zip(index, _index(s.units), strict=True))
                rows.append((n, len(p), sha(p), zlib.crc32(p[-16:]), len(media), sha(media), feature(s), len(s.units), sum(u[3] for u in s.units), s.continuity_errors, holds))
            names = [f.strip().split(" ")[0] for f in _DIGEST.split(",")]
            out = pd.DataFrame(rows, columns=names[1:])
            out.insert(0, "doc_id", whole_ids(batch.doc_id))
            yield out

    return stored.select(text_id("doc_id").alias("doc_id"), "n_bytes", "media", "pts", "payload_offsets", "packets", "random_access").mapInPandas(trimmed(run), _DIGEST)


_DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, n_units long, n_access_points long, continuity_errors long, index_holds boolean"
)


def access_units(stored: DataFrame) -> DataFrame:
    """One row per access unit, from the stored index: doc_id, unit, pts, payload_offset, packet, random_access."""
    units = stored.select("doc_id", F.posexplode(F.arrays_zip("pts", "payload_offsets", "packets", "random_access")).alias("unit", "u"))
    return units.select("doc_id", "unit", "u.pts", F.col("u.payload_offsets").alias("payload_offset"), F.col("u.packets").alias("packet"), "u.random_access")
