"""Near duplicates by SimHash: fingerprints, pigeonhole blocks and exact Hamming distances.

A fingerprint has 64 bits; bit i is set where over half of the text's shingle
hashes have it. Fingerprints that differ in at most d bits agree in at least
b - d of b blocks, so each is filed under every choice of b - d blocks (a
table), and close ones meet in some bucket whatever the bits are. b follows
from the number of fingerprints: more blocks mean more tables of longer keys.

Equal fingerprints are one node from the start. A task gets whole buckets and
hands on pairs that join what is linked within each, not all linked pairs: a
star for each component of a longer bucket. A bucket of more than LONG nodes is
split by the bits that its key leaves open, by the same argument; one that
bits don't split (a dense cloud) is dealt out as pairs of its parts, so no task
holds more than about LONG nodes of a bucket. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm._common import lookup, materialise, text_id, trimmed, whole_ids
from mnemospark.llm.minhash import components

BITS = 64
SEED = 42
#: Shingles whose bits are counted at once: bounds memory for very long texts.
COUNTED = 8192
#: Comparing two fingerprints costs about this part of filing one.
COMPARE = 1 / 50
#: Buckets of more nodes are split by the bits that their key leaves open, so many times at most, then dealt out in pairs of parts.
LONG, LEVELS = 4096, 3
#: Buckets of so many nodes at most are compared many at a time.
SHORT = 32
#: Fingerprints of a frontier that are compared at once with all open ones.
FRONTIER = 512

KEY = ["combo", "bits"]


def fingerprint(text: str, words: int = 4) -> int:
    """The 64-bit fingerprint of a text's word shingles (repeats included); 0 without words."""
    tokens = text.encode().lower().split()  # of bytes: A-Z only, ASCII white space only
    if not tokens:
        return 0
    joined, width = b" ".join(tokens), min(words, len(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    ones, hashed = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(starts), COUNTED):
        spans = zip(starts[k : k + COUNTED], ends[k : k + COUNTED], strict=True)
        h = np.array([hashed(joined[a:b], SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) per row of docs; a stored table. Null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.text], np.uint64)
            yield pd.DataFrame({"doc_id": whole_ids(batch.doc_id), "fp": fps.view(np.int64)})

    texts = docs.select(text_id("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialise(texts.mapInPandas(trimmed(run), "doc_id long, fp long"), "fingerprints")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def cut_bits(places: list[int], blocks: int) -> list[int]:
    """The masks of `blocks` runs of about equal length over the given bit places."""
    bounds = [len(places) * k // blocks for k in range(blocks + 1)]
    return [sum(1 << p for p in places[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


def tables(nodes: int, distance: int) -> list[int]:
    """The masks of the tables: every choice of b - distance of b blocks, for the cheapest b."""

    def cost(b: int) -> float:
        return comb(b, distance) * (1 + COMPARE * nodes / 2 ** (BITS * (b - distance) / b))

    blocks = cut_bits(list(range(BITS)), min(range(distance + 1, distance + 6), key=cost))
    return [sum(chosen) for chosen in combinations(blocks, len(blocks) - distance)]


def group_links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of one bucket that join exactly its linked places: a star from the first place of each component.

    Breadth first: a place is compared, as part of the frontier, with those
    not yet reached, and never again.
    """
    open_, ends = np.arange(len(fps)), ([], [])
    while len(open_) > 1:
        root, open_ = open_[0], open_[1:]
        frontier = np.array([root])
        while len(frontier) and len(open_):
            near = np.zeros(len(open_), bool)
            for k in range(0, len(frontier), FRONTIER):
                apart = np.bitwise_count(fps[frontier[k : k + FRONTIER], None] ^ fps[None, open_])
                near |= (apart <= distance).any(axis=0)
            frontier, open_ = open_[near], open_[~near]
            ends[0].append(np.full(len(frontier), root))
            ends[1].append(frontier)
    return tuple(np.concatenate([np.zeros(0, np.int64), *e]) for e in ends)


def bucket_links(starts: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that join the linked places of each bucket; buckets lie between the places `starts`.

    Short buckets are compared all at once, each place with the ones behind
    it (at most SHORT - 1); long ones by group_links().
    """
    ends = np.append(starts[1:], len(fps))
    size = ends - starts
    bucket = np.repeat(np.arange(len(starts)), size)
    short = np.flatnonzero(size[bucket] <= SHORT)
    pairs = []
    for lag in range(1, min(SHORT, int(size.max(initial=0)))):
        x = short[short + lag < len(fps)]
        x = x[bucket[x] == bucket[x + lag]]
        x = x[np.bitwise_count(fps[x] ^ fps[x + lag]) <= distance]
        pairs.append((x, x + lag))
    for k in np.flatnonzero(size > SHORT):
        a, b = group_links(fps[starts[k] : ends[k]], distance)
        pairs.append((a + starts[k], b + starts[k]))
    return tuple(np.concatenate([np.zeros(0, np.int64), *(p[i] for p in pairs)]) for i in range(2))


def _links(distance: int):
    """Rows come sorted by bucket; pairs of fingerprints come out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            change = np.flatnonzero((held[KEY].to_numpy()[1:] != held[KEY].to_numpy()[:-1]).any(axis=1)) + 1
            if len(change):  # the last bucket may go on in the next batch
                yield found(held.iloc[: change[-1]], np.r_[0, change[:-1]])
                held = held.iloc[change[-1] :].reset_index(drop=True)
        if held is not None and len(held):
            yield found(held, np.zeros(1, np.int64))

    def found(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        fps = rows.fp.to_numpy()
        a, b = bucket_links(starts, fps.view(np.uint64), distance)
        return pd.DataFrame({"x": fps[a], "y": fps[b]})

    return run


def _finer(rows: DataFrame, distance: int) -> DataFrame:
    """rows of long buckets under the distance + 1 blocks of the bits that their mask leaves open: the same argument again."""
    bits = F.array(*[F.lit(p) for p in range(BITS)])
    places = F.filter(bits, lambda p: F.getbit(F.col("mask"), p) == 0)
    n, parts = F.size("places"), F.sequence(F.lit(0), F.lit(distance))
    part = lambda k: F.slice("places", F.floor(n * k / (distance + 1)).cast("int") + 1, F.floor(n * (k + 1) / (distance + 1)).cast("int") - F.floor(n * k / (distance + 1)).cast("int"))
    masks = F.transform(parts, lambda k: F.aggregate(part(k), F.col("mask"), lambda m, p: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p))))
    dealt = rows.withColumn("places", places).select("fp", "combo", F.posexplode(masks).alias("part", "mask"))
    return dealt.select("fp", (F.col("combo") * (distance + 2) + F.col("part") + 1).alias("combo"), F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), "mask")


def _paired(rows: DataFrame) -> DataFrame:
    """rows of long buckets (n each) in parts of about LONG / 2, every two parts as one bucket of their own."""
    parts = F.ceil(F.col("n") * 2 / LONG).cast("int")
    dealt = rows.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")))
    with_other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = F.xxhash64("bits", F.least("own", "other"), F.greatest("own", "other"))  # buckets that a hash joins are only compared in vain
    return with_other.select("fp", "combo", pair.alias("bits"), "mask")


def fingerprint_links(fps: DataFrame, nodes: int, distance: int) -> DataFrame:
    """x, y: pairs of the fingerprints (fp, distinct; `nodes` of them) that join exactly the linked ones; a stored table."""
    masks = tables(nodes, distance)
    filed = F.posexplode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks]))
    rows = fps.select("fp", filed.alias("combo", "mask")).select("fp", F.col("combo").cast("long"), F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), "mask")
    buckets = []
    for level in range(LEVELS + 1):
        long = materialise(rows.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") > LONG), "long-buckets")
        if long.isEmpty():
            break
        buckets.append(rows.join(long, KEY, "left_anti"))
        rows = rows.join(long, KEY)
        rows = materialise(_finer(rows, distance) if level < LEVELS else _paired(rows), "finer-buckets")
    buckets.append(rows)
    dealt = reduce(DataFrame.unionByName, buckets).select(*KEY, "fp").repartition(*KEY).sortWithinPartitions(*KEY)
    return materialise(dealt.mapInPandas(trimmed(_links(distance)), "x long, y long").distinct(), "links")


def link_components(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of at most `distance`
    differing bits reach (null only if all its ids are null). A text with
    fewer words than a shingle has one of all its words; a null, empty or
    blank text has fingerprint zero and is linked like any other. Rows
    repeated under one id get equal answers. Other columns of docs are not
    read.
    """
    fps = fingerprints(docs, words)
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n_rows")), "nodes")
    links = fingerprint_links(nodes.select("fp"), nodes.count(), distance)
    # A hash of one long is a bijection: contraction wants its nodes in random order.
    node = F.xxhash64("fp").alias("node")
    placed = nodes.select("*", node)
    if links.isEmpty():
        placed = placed.withColumn("comp", F.col("node"))
    else:
        comps = components(materialise(links.select(F.xxhash64("x").alias("a"), F.xxhash64("y").alias("b")), "node-links"))
        placed = placed.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = materialise(placed, "placed-nodes")
    named = materialise(placed.groupBy("comp").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n_nodes")), "named-components")
    of_fp = materialise(lookup(placed, named, ["comp"], "n_nodes", ["node"]).select("fp", "component_id", "n_rows"), "named-nodes")
    rows = lookup(fps, of_fp, ["fp"], "n_rows", ["doc_id"])
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """docs with the row of the smallest doc_id of each component; keeps the columns.

    Rows without an id are kept; rows repeated under one id stay or go together.
    """
    gone = link_components(docs, words, distance).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
