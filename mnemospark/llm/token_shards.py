"""Training order: token sequences in fixed-stride binary shards, in a keyed random order.

1. Documents are encoded and cut into sequences, which are stored; a manifest
   of the stored parts (sequences of each, and those before it) numbers all
   sequences from 0 to N - 1 without gaps.
2. A keyed Feistel network permutes range(N); cycle-walking keeps it there.
   The image of a sequence's number is its global slot.
3. Slots are cut into ranges of equal length. Each range is sorted and written
   by one task to one file of records of equal length, so slot s is record
   s % records of shard s // records, at HEADER_BYTES + record * stride. A
   reader can resume at any slot, and a slot's number (its inverse image)
   says which stored part has it.

The numbers follow the stored parts, which follow Spark's cut of the input:
one stored table and one key give one order, however often slots are written
again.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm._common import materialise, open_fs, text_id, trimmed, whole_ids
from mnemospark.llm.bpe import grouped, tokenizer
from mnemospark.storage import shared_path

MAGIC = b"MNSHARD2"
#: magic, stride, tokens a record, bytes a token.
HEADER, HEADER_BYTES = "<8sIII", 20
#: Before a record's tokens: slot, number, doc_id, whether doc_id is null, piece, tokens used.
RECORD = np.dtype([("slot", "<i8"), ("number", "<i8"), ("doc_id", "<i8"), ("no_id", "<u4"), ("piece", "<u4"), ("length", "<u4")])
SEQUENCE_TOKENS = 256
SHARD_BYTES = 32 << 20
END_TOKEN = "<|endoftext|>"
#: Bytes a stored token; 4 for vocabularies of more than 65536 tokens.
TOKEN_BYTES = 2
ROUNDS = 6
#: Shards are written in so many turns, so that shuffle files hold a part of the tokens at a time.
WAVES = 2
LARGEST_DOMAIN = 1 << 62
READ_RECORDS = 4096


class Feistel:
    """A keyed permutation of range(domain) for any domain up to 2**62."""

    def __init__(self, domain: int, key: int, rounds: int = ROUNDS):
        if not 0 < domain <= LARGEST_DOMAIN:
            raise ValueError("the domain must lie in 1 .. 2**62")
        self.domain = domain
        self.half = np.uint64(max(1, ((domain - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        state, self.keys = key & 0xFFFFFFFFFFFFFFFF, []
        for _ in range(rounds):
            state = (state + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
            self.keys.append(np.uint64(state ^ (state >> 29)))

    def _f(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & self.mask

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        x = step(x)
        out = np.flatnonzero(x >= np.uint64(self.domain))
        while len(out):  # cycle-walking: the network's cube is at most four times the domain
            x[out] = step(x[out])
            out = out[x[out] >= np.uint64(self.domain)]
        return x

    def _forth(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ self._f(right, key)
        return left << self.half | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in reversed(self.keys):
            left, right = right ^ self._f(left, key), left
        return left << self.half | right

    def permute(self, x: np.ndarray) -> np.ndarray:
        return self._walk(np.asarray(x, np.uint64), self._forth)

    def invert(self, x: np.ndarray) -> np.ndarray:
        return self._walk(np.asarray(x, np.uint64), self._back)


def _record_type(tokens: int, token_bytes: int) -> np.dtype:
    return np.dtype([*[(n, RECORD[n]) for n in RECORD.names], ("ids", f"<u{token_bytes}", (tokens,))])


@dataclass
class Order:
    """Stored sequences, how many there are, and the permutation of their numbers."""

    rows: DataFrame
    parts: DataFrame
    sequences: int
    feistel: Feistel

    def slots(self) -> DataFrame:
        """The sequences with number and slot."""
        permute = self.feistel.permute

        @F.pandas_udf("long")
        def slot(number: pd.Series) -> pd.Series:
            return pd.Series(permute(number.to_numpy()).astype(np.int64))

        # A row for each stored part, which is one task's work: bounded by the number of tasks.
        numbered = self.rows.join(F.broadcast(self.parts.select("part", "first_number")), "part").withColumn("number", F.col("first_number") + F.col("place"))
        return numbered.withColumn("slot", slot("number"))


def sequences(docs: DataFrame, path: str, key: int, tokens: int = SEQUENCE_TOKENS, end_token: str = END_TOKEN, token_bytes: int = TOKEN_BYTES) -> Order:
    """Encode, cut, store and number: doc_id, piece, ids (binary) and the part and place that make a sequence's number.

    A document's sequences are its ids (null text: none) and that of end_token,
    cut every `tokens` ids. Ids that do not fit token_bytes are an error.
    """
    from pyspark import TaskContext

    texts = docs.select(text_id("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kind = f"<u{token_bytes}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, place, bpe = TaskContext.get().partitionId(), 0, tokenizer(path)
        if len(bpe.tokens) > 1 << 8 * token_bytes:
            raise ValueError(f"{path}: {len(bpe.tokens)} tokens do not fit {token_bytes} bytes")
        end = bpe.special[end_token]
        for group in grouped(batches):
            doc_ids, piece, ids = [], [], []
            for doc, x in zip(group.doc_id, bpe.encode_batch(group.text), strict=True):
                x = np.append(x, end).astype(kind)
                n = -(-len(x) // tokens)
                doc_ids += [doc] * n
                piece += range(n)
                ids += [x[k * tokens : (k + 1) * tokens].tobytes() for k in range(n)]
            yield pd.DataFrame({"part": part, "place": np.arange(place, place + len(ids)), "doc_id": whole_ids(doc_ids), "piece": piece, "ids": ids})
            place += len(ids)

    rows = materialise(texts.mapInPandas(trimmed(run), "part int, place long, doc_id long, piece int, ids binary"), "sequences")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    counted = rows.groupBy("part").agg(F.count("*").alias("sequences"))
    parts = materialise(counted.withColumn("first_number", F.coalesce(F.sum("sequences").over(before), F.lit(0))), "sequence-parts")
    total = parts.agg(F.sum("sequences")).first()[0] or 0
    return Order(rows, parts, total, Feistel(max(1, total), key))


def write_shards(order: Order, folder: str, tokens: int = SEQUENCE_TOKENS, shard_bytes: int = SHARD_BYTES, token_bytes: int = TOKEN_BYTES) -> DataFrame:
    """Write each range of slots to one file; returns the stored manifest.

    Manifest: shard, file, records, first_slot. All shards but the last have
    the same count of records. Files have fresh names, so only those of
    committed attempts are listed. Without sequences there is no file.
    """
    kind = _record_type(tokens, token_bytes)
    records = max(1, shard_bytes // kind.itemsize)
    shards = max(1, -(-order.sequences // records))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        at, file, n, name = None, None, 0, ""

        def close() -> pd.DataFrame:
            file.close()
            return pd.DataFrame({"shard": [at], "file": [f"{folder}/{name}"], "records": [n]})

        for batch in batches:
            for shard, part in batch.groupby("shard", sort=True):
                if shard != at:
                    if file is not None:
                        yield close()
                    at, n, name = int(shard), 0, f"shard-{shard:06d}-{uuid.uuid4().hex}.bin"
                    file = fs.open_output_stream(f"{base}/{name}", compression=None)
                    file.write(struct.pack(HEADER, MAGIC, kind.itemsize, tokens, token_bytes))
                slots = part.slot.to_numpy()
                if slots[0] != at * records + n or (np.diff(slots) != 1).any():
                    raise ValueError(f"shard {at}: a slot is missing or taken twice")
                out = np.zeros(len(part), kind)
                doc = whole_ids(part.doc_id)
                out["slot"], out["number"], out["piece"] = slots, part.number, part.piece
                out["doc_id"], out["no_id"] = doc.fillna(0).to_numpy(np.int64), doc.isna()
                out["length"] = [len(x) // token_bytes for x in part.ids]
                out["ids"] = np.frombuffer(b"".join(x.ljust(token_bytes * tokens, b"\0") for x in part.ids), kind["ids"].base).reshape(-1, tokens)
                file.write(out.tobytes())
                n += len(part)
        if file is not None:
            yield close()

    rows = order.slots().select(F.floor(F.col("slot") / records).cast("int").alias("shard"), "slot", "number", text_id("doc_id").alias("doc_id"), "piece", "ids")
    bounds = sorted({shards * k // WAVES for k in range(WAVES + 1)})
    written = []
    for low, high in zip(bounds, bounds[1:]):
        wave = rows.where((F.col("shard") >= low) & (F.col("shard") < high))
        ranges = wave.repartitionById(high - low, F.col("shard") - low).sortWithinPartitions("slot")
        written.append(materialise(ranges.mapInPandas(trimmed(run), "shard int, file string, records long"), "shard-manifest"))
    return reduce(DataFrame.unionByName, written).withColumn("first_slot", F.col("shard") * F.lit(records).cast("long"))


def read_shard(uri: str, start: int = 0) -> Iterator[np.ndarray]:
    """The records of one shard file from record `start` on, in blocks."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as file:
        magic, stride, tokens, token_bytes = struct.unpack(HEADER, file.read(HEADER_BYTES))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard file")
        kind = _record_type(tokens, token_bytes)
        if stride != kind.itemsize or (file.size() - HEADER_BYTES) % stride:
            raise ValueError(f"{uri} is not a whole shard file")
        file.seek(HEADER_BYTES + start * stride)
        while data := file.read(stride * READ_RECORDS):
            yield np.frombuffer(data, kind)


def read_shards(manifest: DataFrame, start_slot: int = 0) -> DataFrame:
    """slot, number, shard, doc_id, piece, length and ids_crc32 of the records from start_slot on; a shard a task.

    Shards before start_slot are not opened, and its own shard is read from its place on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, uri, records, first in zip(batch.shard, batch.file, batch.records, batch.first_slot, strict=True):
                at = max(0, start_slot - first)
                for block in read_shard(uri, at) if at < records else ():
                    slots = block["slot"].astype(np.int64)
                    if (slots != first + at + np.arange(len(block))).any():
                        raise ValueError(f"{uri}: a record is out of its place")
                    doc = pd.Series(block["doc_id"].astype(np.int64)).astype("Int64").mask(pd.Series(block["no_id"] > 0))
                    crc = [zlib.crc32(x[:n].astype("<u4").tobytes()) for x, n in zip(block["ids"], block["length"].tolist(), strict=True)]
                    yield pd.DataFrame({"slot": slots, "number": block["number"].astype(np.int64), "shard": shard, "doc_id": doc, "piece": block["piece"].astype(np.int32), "length": block["length"].astype(np.int64), "ids_crc32": crc})
                    at += len(block)

    wanted = manifest.where(F.col("first_slot") + F.col("records") > start_slot)
    spread = wanted.repartition(max(1, wanted.count()))
    return spread.mapInPandas(trimmed(run), "slot long, number long, shard int, doc_id long, piece int, length long, ids_crc32 long")


def training_order(docs: DataFrame, path: str, key: int, tokens: int = SEQUENCE_TOKENS, shard_bytes: int = SHARD_BYTES, end_token: str = END_TOKEN, token_bytes: int = TOKEN_BYTES) -> DataFrame:
    """Write docs' sequences in training order and read them back: read_shards()'s columns.

    Null and empty texts give one sequence of the end token alone; rows
    repeated under one id, and rows without one, each get slots of their own.
    An empty table gives no rows. Other columns are not read.
    """
    order = sequences(docs, path, key, tokens, end_token, token_bytes)
    return read_shards(write_shards(order, shared_path(docs.sparkSession, "shards"), tokens, shard_bytes, token_bytes))
