"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Signatures take two permutations of a universe of 2**32 places: one scatters
the shingles, the other, circularly shifted by k, gives coordinate k of the
signature. Signatures are cut into bands; documents that agree in a band share
a bucket. Documents with equal shingle sets are one node from the start.

Links are confirmed on full sets, and no bucket's pairs are all emitted:
1. Star rounds: each node of a bucket meets only the bucket's leader of that
   round (any node, by a hash), where their components still differ.
2. The rest: in buckets that still hold several components, the nodes outside
   the bucket's largest component meet the nodes of other components.
Both are joins whose condition drops unlike pairs before they become rows: a
node carries a parity sketch of its set, and the differing bits of two
sketches never outnumber the shingles that are in one set only, so the test
loses no link. Nothing is capped: every link between two nodes that share a
bucket is either confirmed or within one component already.
A pair at the threshold shares no bucket with a chance under MISS.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm._common import lookup, materialise, text_id, trimmed, whole_ids

COORDINATES = 128
MISS = 1e-6
STAR_ROUNDS = 3
SKETCH_LONGS = 16
GROUP_BYTES = 2 << 20
MEMO_WORDS = 500_000


def banding(threshold: float) -> tuple[int, int]:
    """(rows a band, bands): the longest bands that miss a pair at the threshold with a chance under MISS."""
    for rows in range(16, 0, -1):
        bands = COORDINATES // rows
        if (1 - threshold**rows) ** bands <= MISS:
            return rows, bands
    return 1, COORDINATES


def _scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation: a bijection of 64-bit hashes onto places, of which the upper 32 bits are taken."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return (x >> np.uint64(32)).astype(np.uint32)


def _permute(x: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of 32-bit places, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinate k: the least second-permutation place of the shingles shifted by k."""
    places = _scatter(shingles)
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(places), 256):
        np.minimum(out, _permute(places[None, a : a + 256] + shifts).min(axis=1), out=out)
    return out


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes; lower-cases A-Z, splits at ASCII white space."""

    def __init__(self, words: int):
        self.words, self._memo = words, {}

    def _mix(self, x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))

    def __call__(self, text: str) -> np.ndarray:
        tokens = text.encode().lower().split()
        if not tokens:
            return np.zeros(0, np.uint64)
        memo = self._memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(tokens).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w)
        ids = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
        width = min(self.words, len(ids))
        h = np.full(len(ids) - width + 1, width, np.uint64)
        for k in range(width):
            h = self._mix(h + ids[k : len(ids) - width + 1 + k])
        return np.unique(h)


def node_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """Each shingle flips one of 64 * SKETCH_LONGS bits."""
    size = 64 * SKETCH_LONGS
    bits = np.bincount((shingles >> np.uint64(17)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _by_bytes(batch: pd.DataFrame, column: str) -> Iterator[pd.DataFrame]:
    start = held = 0
    for i, value in enumerate(batch[column]):
        held += len(value)
        if held >= GROUP_BYTES:
            yield batch.iloc[start : i + 1]
            start, held = i + 1, 0
    if start < len(batch):
        yield batch.iloc[start:]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(text_id("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def signatures(docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """doc_id, n_shingles, node (null: no words), sketch and one 64-bit hash a band; a stored table."""
    rows, bands = banding(threshold)
    empty = [0] * SKETCH_LONGS, [0] * bands

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(words)
        for batch in batches:
            for part in _by_bytes(batch, "text"):
                out = []
                for doc, text in zip(whole_ids(part.doc_id), part.text, strict=True):
                    s = shingle(text)
                    if not len(s):
                        out.append((doc, 0, None, *empty))
                        continue
                    sig = signature(s, rows * bands)
                    hashes = [xxhash.xxh64_intdigest(sig[k * rows : (k + 1) * rows].tobytes(), k) for k in range(bands)]
                    out.append((doc, len(s), node_of(s), parity_sketch(s), np.array(hashes, np.uint64).view(np.int64)))
                yield pd.DataFrame(out, columns=["doc_id", "n", "node", "sketch", "bands"]).astype({"doc_id": "Int64"})

    return materialise(_texts(docs).mapInPandas(trimmed(run), "doc_id long, n long, node binary, sketch array<long>, bands array<long>"), "signatures")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and its sorted shingles, for the nodes of the (few) wanted document ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(words)
        for batch in batches:
            for part in _by_bytes(batch, "text"):
                sets = [s for s in map(shingle, part.text) if len(s)]
                yield pd.DataFrame({"node": [node_of(s) for s in sets], "shingles": [s.tobytes() for s in sets]})

    texts = _texts(docs)
    chosen = texts.join(wanted, texts["doc_id"].eqNullSafe(text_id(wanted["wanted_id"])), "left_semi")
    sets = chosen.mapInPandas(trimmed(run), "node binary, shingles binary")
    return materialise(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "shingle-sets", "uncompressed")


def _like(threshold: tuple[int, int], a: str, b: str) -> Column:
    """Pairs whose sets may differ in few enough shingles: d * |A and B| >= n * |A or B| is |A ^ B| * (d + n) <= (|A| + |B|) * (d - n)."""
    n, d = threshold
    differs = [F.bit_count(F.col(f"{a}.sketch")[k].bitwiseXOR(F.col(f"{b}.sketch")[k])) for k in range(SKETCH_LONGS)]
    low, high = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (low * d >= high * n) & (reduce(Column.__add__, differs) * (d + n) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (d - n))


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b and other columns) whose full sets have d * |A and B| >= n * |A or B|."""
    n, d = threshold
    pairs_columns = pairs.columns
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hit = []
            for x, y in zip(batch.sa, batch.sb, strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate((p, q)))
                common = int((both[1:] == both[:-1]).sum())
                hit.append(d * common >= n * (len(p) + len(q) - common))
            yield batch.loc[hit, pairs_columns]

    return both.mapInPandas(trimmed(run), pairs.schema)


def components(edges: DataFrame) -> DataFrame:
    """node -> comp (the least node of its component) for every node that a stored table of edges (a, b) has.

    Each round maps every node to its least neighbour or itself and contracts
    the edges; nodes are digests, so their order is random and each round
    removes a constant part of them. Rounds are stored tables; nothing is
    collected.
    """
    steps: list[DataFrame] = []
    spark = edges.sparkSession
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "component-step")
        steps.append(step)
        mapped = edges.join(step.select("a", F.col("m").alias("ma")), "a").join(step.select(F.col("a").alias("b"), F.col("m").alias("mb")), "b")
        edges = materialise(mapped.where("ma <> mb").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct(), "component-edges")
    if not steps:
        return spark.createDataFrame([], "node binary, comp binary")
    out = steps[-1].select(F.col("a").alias("node"), F.col("m").alias("comp"))
    for step in reversed(steps[:-1]):
        up = out.select(F.col("node").alias("m"), "comp")
        out = step.join(up, "m", "left").select(F.col("a").alias("node"), F.coalesce("comp", "m").alias("comp"))
    return materialise(out, "components")


def _with_comp(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def mixed_buckets(buckets: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The rows of buckets that hold several components, with comp and the bucket's largest component; a stored table."""
    placed = _with_comp(buckets, comps)
    if comps is None:
        return materialise(placed.withColumn("largest", F.lit(None).cast("binary")), "mixed-buckets")
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("key").agg(F.max_by("comp", F.struct("size", "comp")).alias("largest"), F.count("*").alias("kinds")).where("kinds > 1")
    return materialise(placed.join(mixed.select("key", "largest"), "key"), "mixed-buckets")


def link_components(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id in the link component of the row's
    shingle set (null only if all its ids are null), and kept says whether
    that is this row's id, null-safely. A text with fewer words than a shingle
    has one shingle of all its words; a null, empty or blank text has none, is
    linked with nothing and kept. Rows repeated under one id get equal
    answers. Other columns of docs are not read.
    """
    sigs = signatures(docs, words, threshold[0] / threshold[1])
    nodes = sigs.where("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"), F.max("doc_id").alias("wanted_id"), F.min("doc_id").alias("least_id"), F.count("*").alias("n_rows"))
    nodes = materialise(nodes, "nodes")
    spread = nodes.select("node", F.posexplode("bands").alias("band", "hash")).select(F.xxhash64("band", "hash").alias("key"), "node")
    full = spread.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key")
    shared = spread.join(full, "key")  # only rows of buckets with two nodes or more
    buckets = materialise(shared.join(nodes.select("node", "n", "sketch"), "node"), "buckets")
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("wanted_id")
    sets = _shingle_sets(docs, wanted, words)
    like = _like(threshold, "x", "y")
    comps: DataFrame | None = None

    def merge(pairs: DataFrame) -> None:
        """Confirm pairs of nodes in unlike components; only the new links between components are contracted."""
        nonlocal comps
        a, b = F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")
        found = materialise(confirmed(pairs.select(a, b, F.col("x.comp").alias("ca"), F.col("y.comp").alias("cb")).dropDuplicates(["a", "b"]), sets, threshold), "links")
        joined = components(materialise(found.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "component-links"))
        if comps is None:
            comps = joined
        else:  # what was linked before may be linked further; what was alone is in `joined` itself
            moved = comps.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("new")), "comp", "left").select("node", F.coalesce("new", "comp").alias("comp"))
            comps = materialise(moved.unionByName(joined.join(comps.select("node"), "node", "left_anti")), "components")

    for k in range(STAR_ROUNDS):
        x = mixed_buckets(buckets, comps)
        if comps is not None and x.isEmpty():
            break
        leader = F.min_by(F.struct("node", "n", "sketch", "comp"), F.xxhash64("node", "key", F.lit(k))).alias("leader")
        leaders = x.groupBy("key").agg(leader).select("key", "leader.*")
        pairs = x.alias("x").join(leaders.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & like)
        merge(pairs)
    else:
        rest = mixed_buckets(buckets, comps)
        x, y = rest.where("comp <> largest").alias("x"), rest.alias("y")
        other = (F.col("y.comp") == F.col("y.largest")) | (F.col("x.node") < F.col("y.node"))
        merge(x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & other & like))
    # A component of many nodes and a node of many rows are dealt out: names go from components to nodes to rows.
    placed = materialise(_with_comp(nodes.select("node", "least_id", "n_rows"), comps), "placed-nodes")
    named = materialise(placed.groupBy("comp").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n_nodes")), "named-components")
    of_node = materialise(lookup(placed, named, ["comp"], "n_nodes", ["node"]).select("node", "component_id", "n_rows"), "named-nodes")
    linked = lookup(sigs.where("node IS NOT NULL").select("doc_id", F.col("n").alias("n_shingles"), "node"), of_node, ["node"], "n_rows", ["doc_id"])
    linked = linked.select("doc_id", "n_shingles", "component_id")
    alone = sigs.where("node IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs with one document (the smallest doc_id) of each link component; keeps the columns.

    Rows without an id are kept; rows repeated under one id stay or go together.
    """
    gone = link_components(docs, words, threshold).where("NOT kept").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
