"""Pattern packing by non-negative least squares over the length histogram.

Documents become token pieces of at most CAPACITY tokens; only the histogram
of piece lengths (CAPACITY counts, whatever the input) reaches the driver.
There, patterns of one to three lengths that fill a sequence are enumerated,
repeat counts are fitted to the histogram by non-negative least squares and
rounded, and what is left is packed best-fit, longest first, on the histogram
as well: sequences that look alike are handled as one group with a count. The
plan is a bounded table of rank intervals per length, and each piece finds its
sequence and place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm._common import gapless_rank, materialise, text_id, trimmed, whole_ids
from mnemospark.llm.bpe import grouped, tokenizer

CAPACITY = 2048
END_ID = 0
#: Three-length patterns take their shortest length from a grid with so many points.
TRIPLE_GRID = 48
SWEEPS = 12


def patterns(capacity: int, present: np.ndarray) -> np.ndarray:
    """Patterns of up to three lengths that fill a sequence: rows of three lengths, 0 for none.

    Only lengths that occur. Triples take their shortest length from a grid,
    so there are at most about TRIPLE_GRID * capacity / 2 of them.
    """
    out = [(capacity, 0, 0)] + [(capacity - b, b, 0) for b in range(1, capacity // 2 + 1)]
    step = max(1, capacity // 3 // TRIPLE_GRID)
    for c in range(1, capacity // 3 + 1, step):
        b = np.arange(c, (capacity - c) // 2 + 1)
        out += np.stack([capacity - c - b, b, np.full(len(b), c)], axis=1).tolist()
    table = np.array(out, np.int64)
    held = np.concatenate(([True], present[1:] > 0))
    return table[held[table].all(axis=1)]


def fit_counts(table: np.ndarray, histogram: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts x >= 0 that least-squares fit the patterns' lengths to the histogram.

    Coordinate descent: each step sets one count to its best value with the
    others held, so few counts leave zero.
    """
    left, x = histogram.astype(float).tolist(), [0.0] * len(table)
    rows = []
    for a, b, c in table.tolist():
        use: dict[int, int] = {}
        for n in (a, b, c):
            if n:
                use[n] = use.get(n, 0) + 1
        rows.append((list(use.items()), float(sum(k * k for k in use.values()))))
    for _ in range(sweeps):
        moved = 0.0
        for i, (use, norm) in enumerate(rows):
            change = 0.0
            for n, k in use:
                change += k * left[n]
            change /= norm
            if x[i] + change < 0:
                change = -x[i]
            if change:
                x[i] += change
                moved += abs(change)
                for n, k in use:
                    left[n] -= k * change
        if moved < 0.5:
            break
    return np.array(x)


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing on a histogram: groups of (sequences, [(length, times)])."""
    by_space: dict[int, list[list]] = {}
    spaces: list[int] = []  # sorted spaces that have groups

    def add(space: int, group: list) -> None:
        if space not in by_space:
            by_space[space] = []
            spaces.insert(int(np.searchsorted(spaces, space)), space)
        by_space[space].append(group)

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = int(np.searchsorted(spaces, length))
            if at == len(spaces):
                each = capacity // length
                whole, rest = divmod(n, each)
                if whole:
                    add(capacity - each * length, [whole, [(length, each)]])
                if rest:
                    add(capacity - rest * length, [1, [(length, rest)]])
                break
            space = spaces[at]
            group = by_space[space].pop()
            if not by_space[space]:
                del by_space[space]
                spaces.pop(at)
            each = min(space // length, n)
            take = min(group[0], n // each)
            if take < group[0]:
                add(space, [group[0] - take, group[1]])
            add(space - each * length, [take, [*group[1], (length, each)]])
            n -= take * each
    return [(n, pattern) for groups in by_space.values() for n, pattern in groups]


@dataclass
class Plan:
    """Rank intervals per length: key = length << 40 | first rank, with the sequence of that rank and the place in it."""

    keys: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    fitted: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length.astype(np.int64) << 40 | rank
        at = np.searchsorted(self.keys, key, side="right") - 1
        return self.sequence[at] + (key - self.keys[at]), self.offset[at]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The packing of a length histogram; fitted counts the sequences that came from patterns."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    left = counts.copy()
    groups: list[tuple[int, list[tuple[int, int]]]] = []
    table = patterns(capacity, counts)
    x = fit_counts(table, counts)
    # A pattern repeats as often as it rounds to and as pieces are left; the surest patterns come first.
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 0.5:
            break
        lengths, times = np.unique(table[i][table[i] > 0], return_counts=True)
        n = int(min(round(x[i]), (left[lengths] // times).min()))
        if n:
            left[lengths] -= n * times
            groups.append((n, list(zip(lengths[::-1].tolist(), times[::-1].tolist(), strict=True))))
    fitted = sum(n for n, _ in groups)
    groups += best_fit({int(k): int(left[k]) for k in np.flatnonzero(left)}, capacity)
    used = np.zeros(capacity + 1, np.int64)
    rows, base = [], 0
    for n, pattern in groups:
        offset = 0
        for length, times in pattern:
            for _ in range(times):
                rows.append((length << 40 | int(used[length]), base, offset))
                used[length] += n
                offset += length
        base += n
    rows.sort()
    keys, sequence, offsets = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    return Plan(keys, sequence, offsets, base, fitted)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document's token pieces.

    A document's ids are those of its whole text (null: empty) and END_ID.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path)
        for part in grouped(batches):
            rows = []
            for doc, ids in zip(whole_ids(part.doc_id), bpe.encode_batch(part.text), strict=True):
                data = np.append(ids, END_ID).astype("<u4")
                for k, start in enumerate(range(0, len(data), capacity)):
                    cut = data[start : start + capacity]
                    rows.append((doc, k, start, len(cut), zlib.crc32(cut.tobytes()), *([cut.astype(np.int32)] if with_ids else [])))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    texts = docs.select(text_id(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInPandas(trimmed(run), schema)


def pack_pieces(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (a stored table of pieces) with sequence_id (gapless from 0) and offset."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    made = cut.sparkSession.sparkContext.broadcast(plan(histogram, capacity))  # bounded by capacity and the pattern grid

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = made.value.place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = gapless_rank(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "rank").withColumn("placed", place("length", "rank"))
    return placed.select(*cut.columns, "placed.sequence_id", "placed.offset")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all documents' token pieces into sequences of at most capacity tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and
    ids). Null and empty texts are one piece of END_ID alone; rows repeated
    under one id are packed each. An empty table gives no rows. Other columns
    of docs are not read.
    """
    return pack_pieces(materialise(pieces(docs, path, capacity, id_col, text_col, with_ids), "pieces"), capacity)
