"""Balanced label propagation: linked documents gather in shards of equal size.

Links are hubs: a document belongs to hubs (here: one, that of its text), and
documents of a hub are neighbours. Linked documents start spread evenly; in
each round joins count the neighbours of every document by shard, and a
document asks to move to the shard that most of them are in. Requests are
granted under quotas: as many from shard i to j as ask the other way, and as
many more as j has room for, most gain first. The quotas come from a histogram
of requests (shard pairs, gain levels and hash cells), the only thing that
reaches the driver. Documents without neighbours cost nothing wherever they
go, so they are placed last and fill every shard to its exact count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm._common import gapless_rank, lookup, materialise

SHARDS = 8
ROUNDS = 6
#: Rounds end when fewer than this part of the linked documents moved.
SETTLED = 0.002
REQUEST_CELLS = 64


def _pick(values: list[Column], at: Column) -> Column:
    """The value whose number is `at`."""
    return F.element_at(F.array(*values), (at + 1).cast("int"))


def requests(placed: DataFrame, links: DataFrame, rooms: list[bool]) -> DataFrame:
    """item, shard, wish and gain of the items that have more neighbours in another shard with room.

    placed: item, shard. links: item, hub. Equal votes are broken alike for
    all items of a hub.
    """
    shards = range(len(rooms))
    at = links.join(placed, "item")
    votes = at.groupBy("hub").agg(F.count("*").alias("n"), *[F.count_if(F.col("shard") == k).alias(f"v{k}") for k in shards])
    tie = [F.when(F.col(f"v{k}") > 0, F.col(f"v{k}") + F.pmod(F.xxhash64("hub", F.lit(k)), F.lit(1000)) / 2500).otherwise(0.0).alias(f"v{k}") for k in shards]
    heard = lookup(at, materialise(votes.select("hub", "n", *tie), "votes"), ["hub"], "n", ["item"]).groupBy("item", "shard").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in shards])
    open_votes = [F.when((F.lit(rooms[k])) | (F.col("shard") == k), F.col(f"v{k}")).otherwise(-1.0) for k in shards]
    most = F.greatest(*open_votes)
    wish = reduce(lambda rest, k: F.when(open_votes[k] == most, F.lit(k)).otherwise(rest), reversed(shards), F.lit(None).cast("int"))
    asked = heard.select("item", "shard", wish.alias("wish"), (most - _pick([F.col(f"v{k}") for k in shards], F.col("shard"))).alias("gain"))
    return asked.where((F.col("wish") != F.col("shard")) & (F.col("gain") > 0))


def _order() -> Column:
    """Larger gains first (by powers of two), then hash cells: a small number."""
    level = F.least(F.floor(F.log2(F.col("gain") + 1)), F.lit(62))
    return ((62 - level) * REQUEST_CELLS + F.pmod(F.xxhash64("item"), F.lit(REQUEST_CELLS))).cast("long")


def grants(histogram: list[tuple[int, int, int, int]], room: list[int]) -> dict[tuple[int, int], int]:
    """For each (from, to): the order number below which requests are granted.

    histogram: (from, to, order, requests). Never grants more than the
    opposite requests and the room of the shard.
    """
    asked: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, j, order, n in histogram:
        asked.setdefault((i, j), []).append((order, n))
    total = {p: sum(n for _, n in x) for p, x in asked.items()}
    cut = dict.fromkeys(asked, 0)
    granted = dict.fromkeys(asked, 0)
    swap = {(i, j): min(n, total.get((j, i), 0)) for (i, j), n in total.items()}

    def largest(pair: tuple[int, int], allowed: int) -> None:
        held = cut[pair] = 0
        for order, n in sorted(asked[pair]):
            if held + n > allowed:
                break
            held, cut[pair] = held + n, order + 1
        granted[pair] = held

    for pair, n in swap.items():
        largest(pair, n)
    # Cells are granted whole, so the two sides of a swap may differ; the smaller side and the room bind.
    for j, free in enumerate(room):
        pairs = sorted(p for p in asked if p[1] == j)
        left = free
        for p in pairs:
            back = granted.get((p[1], p[0]), 0)
            over = max(0, granted[p] - back)
            if over > left:
                largest(p, back + left)
                over = max(0, granted[p] - back)
            left -= over
        for p in pairs:
            more = total[p] - granted[p]
            if more and left > 0:
                was = granted[p]
                largest(p, was + min(more, left))
                left -= granted[p] - was
    # A later cut of one side may leave the other with too few returns: settle until no shard overflows.
    while True:
        net = [sum(granted[p] for p in asked if p[1] == j) - sum(granted[p] for p in asked if p[0] == j) for j in range(len(room))]
        bad = [j for j in range(len(room)) if net[j] > room[j]]
        if not bad:
            return cut
        p = max((p for p in asked if p[1] == bad[0] and granted[p]), key=lambda p: granted[p])
        largest(p, max(0, granted[p] - (net[bad[0]] - room[bad[0]])))


def propagate(links: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """item, shard for every item of links (item, hub; a stored table); no shard gets more than its quota."""
    shards = len(quota)
    items = materialise(links.select("item").distinct(), "linked-items")
    linked = items.count()
    spread = gapless_rank(items.withColumn("all", F.lit(0)), ["all"], ["item"], "rank")
    placed = materialise(spread.select("item", F.pmod("rank", F.lit(shards)).cast("int").alias("shard")), "placed")
    for _ in range(rounds if linked else 0):
        sizes = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        room = [quota[k] - sizes.get(k, 0) for k in range(shards)]
        # A full shard may still be asked for: those that leave it make room.
        asked = materialise(requests(placed, links, [True] * shards).withColumn("order", _order()), "requests")
        histogram = asked.groupBy("shard", "wish", "order").agg(F.count("*").alias("n")).collect()  # shards^2 x 63 x REQUEST_CELLS rows at most
        cut = grants([(r["shard"], r["wish"], r["order"], r["n"]) for r in histogram], room)
        moved = sum(r["n"] for r in histogram if r["order"] < cut[r["shard"], r["wish"]])
        if not moved:
            # Nobody can go where most neighbours are: ask once more for shards that have room.
            asked = materialise(requests(placed, links, [x > 0 for x in room]).withColumn("order", _order()), "requests")
            histogram = asked.groupBy("shard", "wish", "order").agg(F.count("*").alias("n")).collect()
            cut = grants([(r["shard"], r["wish"], r["order"], r["n"]) for r in histogram], room)
            moved = sum(r["n"] for r in histogram if r["order"] < cut[r["shard"], r["wish"]])
        if not moved:
            break
        limit = _pick([F.lit(cut.get((i, j), 0)) for i in range(shards) for j in range(shards)], F.col("shard") * shards + F.col("wish"))
        going = asked.where(F.col("order") < limit).select("item", "wish")
        placed = materialise(placed.join(going, "item", "left").select("item", F.coalesce("wish", "shard").alias("shard")), "placed")
        if moved < SETTLED * linked:
            break
    return placed


def cut_links(placed: DataFrame, links: DataFrame) -> DataFrame:
    """One row: pairs of neighbours, and how many of them lie in different shards."""
    by_shard = links.join(placed, "item").groupBy("hub", "shard").agg(F.count("*").alias("n"))
    by_hub = by_shard.groupBy("hub").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("inside"))
    pairs = F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))
    return by_hub.agg(pairs.alias("pairs"), (pairs - F.coalesce(F.sum("inside"), F.lit(0.0))).alias("cut"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Put all docs into shards of row counts at most one apart, equal texts together where counts allow.

    Returns doc_id, size, text_crc32, law (`rows`), shard, slot (gapless from
    0 in a shard) and grown_shard (null). Null text counts as empty and
    belongs with empty texts. Rows repeated under one id are rows of their
    own; rows without an id are placed like any. An empty table gives no
    rows. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(
        F.monotonically_increasing_id().alias("item"), F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hub"),
    )
    items = materialise(read, "items")
    total = items.count()
    quota = [total // shards + (k < total % shards) for k in range(shards)]
    shared = materialise(items.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1"), "hubs")
    links = materialise(lookup(items, shared, ["hub"], "n", ["item"]).where("n IS NOT NULL").select("item", "hub"), "links")
    placed = propagate(links, quota, rounds)
    held = items.join(placed, "item").drop("hub")
    slotted = gapless_rank(materialise(held, "linked"), ["shard"], ["item"], "slot")
    sizes = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    # Those without neighbours fill up the shards: their overall rank says which, and the slot there.
    single = materialise(items.join(links.select("item"), "item", "left_anti").drop("hub").withColumn("all", F.lit(0)), "singles")
    ranked = gapless_rank(single, ["all"], ["item"], "rank")
    shard, slot, begin = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for k in range(shards):
        used = sizes.get(k, 0)
        here = (F.col("rank") >= begin) & (F.col("rank") < begin + quota[k] - used)
        shard, slot = F.when(here, F.lit(k)).otherwise(shard), F.when(here, F.col("rank") - begin + used).otherwise(slot)
        begin += quota[k] - used
    filled = ranked.select("doc_id", "size", "text_crc32", shard.alias("shard"), slot.alias("slot"))
    out = slotted.select("doc_id", "size", "text_crc32", "shard", "slot").unionByName(filled)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
