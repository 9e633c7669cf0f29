"""Exact scans of all nodes by all queries, in blocks of vectors.

A task gets a block of nodes beside a block of queries. One matrix product
tells which pairs can count, and only those are scored as `vec.cosine` scores
them, element after element, so equal vectors have equal scores wherever they
lie. What a block hands on is what its floor and its best k leave; the caller
ranks that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from mnemospark.storage import cut

#: Rows of a block at most, and blocks that a table is cut into at least where it has rows enough for them.
ROWS, SPREAD, FEWEST = 8192, 32, 256
#: Cells of one matrix of scores; rows of one batch handed on.
CELLS, BATCH = 1 << 21, 1 << 16
#: Bytes of an Arrow batch (one row at least): a row holds two blocks.
BATCH_BYTES = 4 << 20
#: How far a product may be from the score, and two values from each other that a caller may round to one.
ERROR, TIE = 1e-9, 2e-6


def _blocks(frame: DataFrame, key: str, name: str, within: str | None) -> tuple[DataFrame, int]:
    """(a stored table of within, block and an array `name` of the rows of the block, number of blocks)."""
    if within is None:
        n = frame.count()
    else:
        n = frame.groupBy(within).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    n = -(-n // min(ROWS, max(FEWEST, n // SPREAD)))
    by = [F.pmod(F.xxhash64(key), F.lit(max(1, n))).cast("int").alias("block"), *([F.col(within).alias("within")] if within else [])]
    return cut(frame.groupBy(*by).agg(F.collect_list(F.struct(*frame.columns)).alias(name)), f"scan-{name}"), max(1, n)


def _matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as rows, their lengths); a vector that is null or holds a null has length -1."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, width = lists.flatten(), int(size.max(initial=0))
    numbers = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.zeros((len(size), width))
    rows[np.arange(width) < size[:, None]] = numbers
    dims = np.where(lists.is_null().to_numpy(zero_copy_only=False), -1, size)
    if flat.null_count:
        bad = np.unique(np.repeat(np.arange(len(size)), size)[flat.is_null().to_numpy(zero_copy_only=False)])
        dims[bad], rows[bad] = -1, 0.0
    return rows, dims


def _fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products along the last axis, summed from left to right."""
    total = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for j in range(a.shape[-1]):
        total += a[..., j] * b[..., j]
    return total


class _Side:
    """One block: its columns, vectors and their norms."""

    def __init__(self, rows: pa.StructArray, vector: str, key: str):
        self.columns = {f.name: rows.field(i) for i, f in enumerate(rows.type) if f.name != vector}
        self.vectors, self.dims = _matrix(rows.field(vector))
        self.norms = np.sqrt(_fold(self.vectors, self.vectors))
        self.tiny = bool(((self.norms > 0) & (self.norms < 1e-140)).any())
        self.plain = {c: a.to_numpy(zero_copy_only=False) for c, a in self.columns.items()}
        self.ids = self.plain[key]

    def widen(self, width: int) -> None:
        self.vectors = np.pad(self.vectors, ((0, 0), (0, width - self.vectors.shape[1])))


def _cosine(dot: np.ndarray, size: np.ndarray, zero: np.ndarray) -> np.ndarray:
    return np.where(zero | (size == 0), 0.0, dot / np.where(size == 0, 1.0, size))


def _groups(side: _Side, by: list[str]) -> list[np.ndarray]:
    """The places of each group of equal `by` (nulls are one)."""
    code = np.zeros(len(side.ids), dtype=np.int64)
    for c in by:
        own = side.columns[c].dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(own.dictionary) + own.indices.to_numpy(), return_inverse=True)[1]
    return [np.flatnonzero(code == g) for g in np.unique(code)]


def _best(value: np.ndarray, may: np.ndarray, groups: list[np.ndarray], k: int) -> np.ndarray:
    """Which pairs of `may` can be among the k of the largest value in their row and group."""
    keep = np.zeros_like(may)
    for g in groups:
        v = np.where(may[:, g], value[:, g], -np.inf)
        if len(g) > k:
            kth = np.partition(v, -k, axis=1)[:, -k, None]
            keep[:, g] = may[:, g] & (v >= kth - TIE - ERROR * np.abs(np.where(np.isfinite(kth), kth, 0.0)))
        else:
            keep[:, g] = may[:, g]
    return keep


def _found(nodes: _Side, queries: _Side, key: str, q_key: str, least, above, k, by, value, itself) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of queries, places of nodes, scores) of the pairs to hand on."""
    width = max(nodes.vectors.shape[1], queries.vectors.shape[1])
    nodes.widen(width), queries.widen(width)
    groups = _groups(nodes, by) if k else []
    place_of = np.unique(nodes.ids, return_inverse=True)[1] if k else None
    group_of = np.zeros(len(nodes.ids), dtype=np.int64)
    for n, g in enumerate(groups):
        group_of[g] = n
    floor = least if above is None else above
    step = max(1, CELLS // max(1, len(nodes.ids)))
    for start in range(0, len(queries.ids), step):
        part = slice(start, start + step)
        q, size = queries.vectors[part], queries.norms[part, None] * nodes.norms
        zero = (queries.dims[part, None] != nodes.dims) | (nodes.dims < 0)
        dot = _fold(q[:, None, :], nodes.vectors[None, :, :]) if nodes.tiny or queries.tiny else q @ nodes.vectors.T
        score = _cosine(dot, size, zero)
        may = np.ones(score.shape, dtype=bool) if floor is None else ~(score < floor - ERROR)
        if not itself:
            may &= queries.ids[part, None] != nodes.ids
        if k:
            ranked = score if value is None else value(score, nodes.plain, {c: a[part, None] for c, a in queries.plain.items()})
            may = _best(np.where(np.isnan(ranked), np.inf, ranked), may, groups, k)
        i, j = np.nonzero(may)
        for at in range(0, len(i), CELLS // 8):
            # Ties are cut within a row; rows may be cut here, which only hands on more.
            a, b = i[at : at + CELLS // 8], j[at : at + CELLS // 8]
            exact = _cosine(_fold(q[a], nodes.vectors[b]), size[a, b], zero[a, b])
            sure = np.ones(len(a), dtype=bool) if floor is None else ~(exact < floor) if above is None else ~(exact <= floor)
            a, b, exact = a[sure], b[sure], exact[sure]
            if k and len(a):
                v = exact if value is None else value(exact, {c: x[b] for c, x in nodes.plain.items()}, {c: x[part][a] for c, x in queries.plain.items()})
                v = np.where(np.isnan(v), np.inf, v)
                order = np.lexsort((place_of[b], v, group_of[b], a))
                a, b, exact, v = a[order], b[order], exact[order], v[order]
                new = np.r_[True, (a[1:] != a[:-1]) | (group_of[b[1:]] != group_of[b[:-1]]) | (v[1:] != v[:-1])]
                run = np.arange(len(a)) - np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
                a, b, exact = a[run < k], b[run < k], exact[run < k]
            yield a + start, b, exact


def scan(nodes: DataFrame, queries: DataFrame, least: float | None = None, above: float | None = None, k: int | None = None, by: tuple[str, ...] = (), value: Callable | None = None, itself: bool = True, within: str | None = None, ordered: bool = False) -> DataFrame:
    """The columns of queries (query_id, q, ...) and nodes (node_id, v, ...) but the vectors, and score: the pairs that count.

    least, above: the score is at least, or more than, this. k: only pairs that
    can be among the k largest of a query and group `by` (columns of nodes) by
    `value` rounded to 6 places or not, the least node_id first; what else the
    blocks hand on must be ranked away. value(score, columns of nodes, columns
    of queries) defaults to the score. itself: a node meets the query of its
    id. within: a column of both; only pairs of one class (not null) meet.
    ordered: only pairs with query_id < node_id.
    """
    spark = nodes.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if within is not None:
        nodes, queries = nodes.where(F.col(within).isNotNull()), queries.where(F.col(within).isNotNull())
    (ns, n), (qs, m) = _blocks(nodes, "node_id", "ns", within), _blocks(queries, "query_id", "qs", within)
    if within is None:
        pairs = ns.select("ns").crossJoin(qs.select("qs"))
    else:
        # Each pair of blocks is a key of its own: a large class is many tasks' work.
        left = ns.select("within", F.col("block").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("b"), "ns")
        right = qs.select("within", F.col("block").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("a"), "qs")
        pairs = left.join(right, ["within", "a", "b"]).select("ns", "qs")
    made = [f for f in queries.schema if f.name != "q" and f.name != within] + [f for f in nodes.schema if f.name != "v"]
    schema = StructType([StructField(f.name, f.dataType, True) for f in made] + [StructField("score", DoubleType(), True)])
    q_names, n_names, groups = [f.name for f in queries.schema if f.name not in ("q", within)], [f.name for f in nodes.schema if f.name != "v"], list(by)

    def run(batches):
        with np.errstate(all="ignore"):
            for batch in batches:
                for row in range(batch.num_rows):
                    own, asked = _Side(batch.column(0)[row].values, "v", "node_id"), _Side(batch.column(1)[row].values, "q", "query_id")
                    for i, j, score in _found(own, asked, "node_id", "query_id", least, above, k, groups, value, itself):
                        if ordered:
                            low = asked.ids[i] < own.ids[j]
                            i, j, score = i[low], j[low], score[low]
                        for at in range(0, len(i), BATCH):
                            a, b = pa.array(i[at : at + BATCH]), pa.array(j[at : at + BATCH])
                            arrays = [asked.columns[c].take(a) for c in q_names] + [own.columns[c].take(b) for c in n_names] + [pa.array(score[at : at + BATCH])]
                            yield pa.RecordBatch.from_arrays(arrays, names=[*q_names, *n_names, "score"])

    return pairs.mapInArrow(run, schema)
