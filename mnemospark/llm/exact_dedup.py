"""Exact duplicates through an extendible-hash index kept in shared files.

Every text has a 64-bit key. A directory maps the leading bits of a key to a
bucket; a bucket that holds more entries than its capacity is split by one
more bit, and the directory doubles when the bucket already used all of its
bits. Each bucket belongs to one owner task, which walks its entries in key
order, chains entries whose keys collide and tells them apart by comparing
bytes. Both the directory (slot, bucket) and the buckets (one row per distinct
text) are written to the shared folder, and rows find their group through
them: slot, bucket, then key and digest within the bucket.

Copies are combined inside each map task before anything is shuffled, so a
text that a third of all rows share reaches its owner once or a few times per
map task, never once per row; and the rows of such a text are dealt out when
they look their group up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm._common import fold_ascii, lookup, materialise, text_id, trimmed, whole_ids

#: A map task hands on what it has combined when its texts reach this many characters.
COMBINE_CHARS = 8 << 20
#: Rows are handed to Spark in slices of so many characters.
SLICE_CHARS = 2 << 20
#: Directory bits never exceed this: at most 2**20 cells are counted on the driver. Past it buckets are longer; owners walk them in key order and never hold one.
MAX_DEPTH = 20


class Directory:
    """An extendible-hash directory grown from the entry counts of its finest cells.

    counts: cell -> entries, for cells of `finest` leading key bits.
    """

    def __init__(self, counts: dict[int, int], finest: int, capacity: int):
        self.finest, self.capacity, self.global_depth = finest, capacity, 0
        self.pointers = [(0, 0)]  # directory slot -> (local depth, prefix)
        sums = {(finest, cell): n for cell, n in counts.items()}
        for depth in range(finest, 0, -1):
            for prefix in {p for d, p in sums if d == depth}:
                up = (depth - 1, prefix >> 1)
                sums[up] = sums.get(up, 0) + sums[depth, prefix]
        full = [b for b in {(0, 0)} if sums.get(b, 0) > capacity]
        while full:
            depth, prefix = full.pop()
            if depth == self.finest:
                continue  # cannot be told apart by directory bits: the owner chains them
            if depth == self.global_depth:
                self.pointers = [p for p in self.pointers for _ in range(2)]
                self.global_depth += 1
            span = 1 << (self.global_depth - depth)
            for half in (0, 1):
                child = (depth + 1, 2 * prefix + half)
                start = prefix * span + half * (span // 2)
                self.pointers[start : start + span // 2] = [child] * (span // 2)
                if sums.get(child, 0) > capacity:
                    full.append(child)

    def bucket_of_slot(self) -> list[int]:
        """Directory slot -> dense bucket number."""
        numbers: dict[tuple[int, int], int] = {}
        return [numbers.setdefault(p, len(numbers)) for p in self.pointers]


def _add(link: list, top: int | None, n: int, n_top: int) -> None:
    """Add n rows, of which n_top have the largest id top (null: all are without an id), to [.., max_id, n, n_top]."""
    if top is not None and (link[-3] is None or top > link[-3]):
        link[-3], link[-1] = top, n_top
    elif top == link[-3]:
        link[-1] += n_top
    link[-2] += n


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per distinct text of the task (or of each COMBINE_CHARS of texts)."""
    held: dict[str, list] = {}
    size = 0

    def flush() -> Iterator[pd.DataFrame]:
        rows, taken = [], 0
        for i, (text, (key, digest, top, n, n_top)) in enumerate(held.items(), 1):
            rows.append((key, digest, text, top, n, n_top))
            taken += len(text)
            if taken >= SLICE_CHARS or i == len(held):
                out = pd.DataFrame(rows, columns=["key", "digest", "text", "max_id", "n", "n_top"])
                yield out.assign(max_id=whole_ids([r[3] for r in rows]))
                rows, taken = [], 0

    for batch in batches:
        for key, digest, text, top in zip(batch.key, batch.digest, batch.text, batch.doc_id, strict=True):
            top = None if top is None else int(top)
            if (entry := held.get(text)) is None:
                held[text] = [key, digest, top, 1, 1]
                size += len(text)
            else:
                _add(entry, top, 1, 1)
        if size > COMBINE_CHARS:
            yield from flush()
            held, size = {}, 0
    yield from flush()


_OWNED = "bucket int, key long, chain int, digest string, keep_id long, group_size long, n_keep long"


def _own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An owner task: entries come in key order; one output row per distinct text."""
    names = [f.split(" ")[0] for f in _OWNED.split(", ")]
    at: int | None = None
    bucket = 0
    chain: list[list] = []  # of the key at hand: [text, digest, max_id, n, n_top]

    def rows() -> list[tuple]:
        return [(bucket, at, j, d, top, n, n_top) for j, (_, d, top, n, n_top) in enumerate(chain)]

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=names).assign(keep_id=whole_ids([r[4] for r in out]))

    for batch in batches:
        out: list[tuple] = []
        for b, key, digest, text, top, n, n_top in zip(batch.bucket, batch.key, batch.digest, batch.text, batch.max_id, batch.n, batch.n_top, strict=True):
            if key != at:
                if at is not None:
                    out += rows()
                at, bucket, chain = key, b, []
            top = None if top is None else int(top)
            for link in chain:
                if link[0] == text:  # the bytes decide, not the key
                    _add(link, top, n, n_top)
                    break
            else:
                chain.append([text, digest, top, n, n_top])
        if out:
            yield frame(out)
    if at is not None:
        yield frame(rows())


@dataclass
class Index:
    """The stored index: its directory (slot, bucket), the bits a slot has, and the buckets' rows."""

    directory: DataFrame
    depth: int
    rows: DataFrame

    def slot(self, key: Column) -> Column:
        return F.shiftrightunsigned(key, 64 - self.depth) if self.depth else F.lit(0).cast("long")

    def find(self, keyed_rows: DataFrame, by: list[str]) -> DataFrame:
        """keyed_rows (key, digest) with bucket, keep_id, group_size and n_keep of their group."""
        # The directory has at most 2**MAX_DEPTH slots of 12 bytes: a proven size for a broadcast.
        placed = keyed_rows.withColumn("slot", self.slot(F.col("key"))).join(F.broadcast(self.directory), "slot").drop("slot")
        return lookup(placed, self.rows.drop("chain"), ["bucket", "key", "digest"], "group_size", by)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the 64-bit key, the SHA-256 and the text, lower-cased in A-Z only."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), fold_ascii(F.coalesce(text_col, F.lit(""))).alias("text"))
    return text.select("doc_id", F.xxhash64("text").alias("key"), F.sha2("text", 256).alias("digest"), "text")


def build_index(docs: DataFrame, bucket_capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of docs; its rows: bucket, key, chain, digest, keep_id, group_size, n_keep, one per distinct text.

    Null text counts as empty. keep_id is the largest id (null only where all
    ids of the group are null), and n_keep how many rows have it. An empty
    table gives an empty index.
    """
    entries = materialise(keyed(docs, id_col, text_col).select("key", "digest", "text", text_id("doc_id").alias("doc_id")).mapInPandas(trimmed(_combine), "key long, digest string, text string, max_id long, n long, n_top long"), "exact-entries")
    keys = entries.select("key").distinct()  # copies of a text reach the index combined, so cells count distinct keys
    finest = min(MAX_DEPTH, max(1, (2 * entries.count() // bucket_capacity).bit_length() + 2))
    cell = F.shiftrightunsigned("key", 64 - finest)
    counts = {r["cell"]: r["n"] for r in keys.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}
    grown = Directory(counts, finest, bucket_capacity)
    spark = docs.sparkSession
    directory = materialise(spark.createDataFrame(list(enumerate(grown.bucket_of_slot())), "slot long, bucket int"), "exact-directory")
    index = Index(directory, grown.global_depth, entries)
    placed = entries.withColumn("slot", index.slot(F.col("key"))).join(F.broadcast(directory), "slot").drop("slot")
    owned = (
        placed.repartition("bucket")
        .sortWithinPartitions("bucket", "key")
        .select("bucket", "key", "digest", "text", text_id("max_id").alias("max_id"), "n", "n_top")
        .mapInPandas(trimmed(_own), _OWNED)
    )
    return Index(directory, grown.global_depth, materialise(owned, "exact-index"))


def exact_duplicates(docs: DataFrame, bucket_capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty and so groups with empty texts. kept compares
    null-safely: in a group of null ids only, keep_id is null and all rows are
    kept; rows repeated with the same id and text are indistinguishable and
    carry the same answer. Other columns of docs are not read.
    """
    index = build_index(docs, bucket_capacity, id_col, text_col)
    found = index.find(keyed(docs, id_col, text_col).drop("text"), ["doc_id"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, bucket_capacity: int = 4096) -> DataFrame:
    """docs without the rows whose text an equal row with a larger doc_id has.

    Keeps the columns of docs; of rows repeated under one doc_id one stays.
    """
    index = build_index(docs, bucket_capacity)
    text = fold_ascii(F.coalesce("text", F.lit("")))
    names = docs.columns
    marked = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs["doc_id"].cast("long").alias("row_id"), F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("digest"))
    kept = index.find(marked, ["row_id"]).where(F.col("row_id").eqNullSafe(F.col("keep_id")))
    # Only rows repeated under one id are grouped.
    again = kept.where("n_keep > 1").groupBy("key", "digest").agg(F.first("row").alias("row"))
    return kept.where("n_keep = 1").select("row").unionByName(again.select("row")).select([F.col(f"row.{c}").alias(c) for c in names])
