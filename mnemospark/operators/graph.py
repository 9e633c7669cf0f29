"""Traversal over edge tables (src, dst, rel_type, confidence), level by level.

Each level is one join of the frontier with the edges; (node, hops) is kept
distinct, so walks that meet do not multiply. A level is a stored table, so a
deep walk neither recomputes the levels before it nor loses them with an
executor. Bounds are the callers' hops.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.storage import cut


def directed(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Edges to follow from `src`: out, in, or both."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return {"out": edges, "in": back, "both": edges.unionByName(back)}[direction]


def reach(edges: DataFrame, start: DataFrame, max_hops: int, direction: str = "out") -> DataFrame:
    """Walks: every node reached in 1..max_hops steps with its fewest hops (start may come back over a cycle).

    start: one column, node.
    """
    # Steps may repeat: each frontier is distinct. Partitions grow with them.
    steps = cut(directed(edges, direction).select("src", "dst"), "steps")
    rows = steps.count()
    frontier, found = start.select("node").distinct(), []
    for hop in range(1, max_hops + 1):
        frontier = frontier.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        if found:  # a node reached earlier leads nowhere that is not known already
            frontier = frontier.join(reduce(DataFrame.unionByName, found), "node", "left_anti")
        frontier = cut(frontier, "frontier", rows=rows)
        if frontier.isEmpty():
            break
        found.append(frontier)
    if not found:
        return frontier.select("node", F.lit(0).alias("hops"))
    return reduce(DataFrame.unionByName, [f.select("node", F.lit(k).alias("hops")) for k, f in enumerate(found, 1)])


def permitted(edges: DataFrame, entry: str, tier: str, policies: DataFrame, max_hops: int = 5, rel_types: tuple[str, ...] = ("INVOKES", "REQUIRES")) -> DataFrame:
    """Targets reachable at a trust tier: node, hops.

    policies: node, mode. A target is blocked at a length if a walk of that
    length to it passes a node with another mode; the fewest unblocked hops
    are returned. Whether any walk is blocked is carried along, not the walks.
    """
    steps = cut(edges.where(F.col("rel_type").isin(*rel_types)).select("src", "dst"), "steps")
    rows = steps.count()
    bad = policies.where(F.col("mode").isNotNull() & (F.col("mode") != tier)).select("node").distinct().withColumn("bad", F.lit(True))
    spark = edges.sparkSession
    level = spark.createDataFrame([(entry,)], "node string").join(bad, "node", "left").select("node", F.coalesce("bad", F.lit(False)).alias("blocked"))
    found = []
    for hop in range(1, max_hops + 1):
        moved = level.join(steps, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.bool_or("blocked").alias("through"))
        level = cut(moved.join(bad, "node", "left").select("node", (F.col("through") | F.coalesce("bad", F.lit(False))).alias("blocked")), "level", rows=rows)
        found.append(level.where("NOT blocked").select("node", F.lit(hop).alias("hops")))
    return reduce(DataFrame.unionByName, found).groupBy("node").agg(F.min("hops").alias("hops"))


def explore(edges: DataFrame, start: str, max_depth: int, direction: str = "out") -> DataFrame:
    """Breadth-first search with first discoverer: node, depth, parent, path, path_strength (mean edge confidence, null counts 1)."""
    weighed = cut(directed(edges, direction).select("src", "dst", F.coalesce("confidence", F.lit(1.0)).alias("w")), "weighed")
    rows = weighed.count()
    steps = cut(weighed.groupBy("src", "dst").agg(F.max("w").alias("w")), "steps", rows=rows)
    spark = edges.sparkSession
    level = spark.createDataFrame([(start,)], "node string").select("node", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.array("node").alias("path"), F.lit(0.0).alias("total"))
    found = [level]
    for depth in range(1, max_depth + 1):
        ahead = level.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.col("node").alias("parent"), F.concat("path", F.array("dst")).alias("path"), (F.col("total") + F.col("w")).alias("total"))
        ahead = ahead.join(reduce(DataFrame.unionByName, found).select("node"), "node", "left_anti")
        first = ahead.groupBy("node").agg(F.min_by(F.struct("parent", "path", "total"), "parent").alias("f"))
        level = cut(first.select("node", F.lit(depth).alias("depth"), "f.parent", "f.path", "f.total"), "level", rows=rows)
        found.append(level)
    every = reduce(DataFrame.unionByName, found)
    return every.where("depth > 0").select("node", "depth", "parent", "path", F.round(F.try_divide("total", "depth"), 3).alias("path_strength"))


def has_cycle_through(edges: DataFrame, source: str, target: str, max_hops: int = 10) -> DataFrame:
    """One row: would an edge source -> target close a cycle, i.e. is source reachable from target (or the same)?"""
    start = edges.sparkSession.createDataFrame([(target,)], "node string")
    hit = reach(edges, start, max_hops).where(F.col("node") == source).agg((F.count("*") > 0).alias("found"))
    return hit.select((F.col("found") | F.lit(source == target)).alias("cycle"))


def ready(tasks: DataFrame, depends: DataFrame, done: tuple[str, ...]) -> DataFrame:
    """Pending tasks (task_id, status) without a dependency (task_id, on_id) outside the done states."""
    open_tasks = tasks.where(~F.col("status").isin(*done)).select(F.col("task_id").alias("on_id"))
    waiting = depends.join(open_tasks, "on_id", "left_semi").select("task_id").distinct()
    return tasks.where(F.col("status") == "pending").join(waiting, "task_id", "left_anti")


def blocked(tasks: DataFrame, depends: DataFrame) -> DataFrame:
    """Pending tasks (task_id) downstream of a failed one, over any number of dependencies (task_id, on_id).

    Level by level over stored tables; a task that is reached again leads nowhere new.
    """
    steps = cut(depends.select("task_id", "on_id").distinct(), "depends")
    frontier = cut(tasks.where("status = 'failed'").select("task_id").distinct(), "frontier")
    found = [frontier]
    while True:
        ahead = steps.join(frontier.select(F.col("task_id").alias("on_id")), "on_id", "left_semi").select("task_id").distinct()
        frontier = cut(ahead.join(reduce(DataFrame.unionByName, found), "task_id", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        found.append(frontier)
    hit = reduce(DataFrame.unionByName, found[1:]) if found[1:] else frontier
    return tasks.where("status = 'pending'").join(hit, "task_id", "left_semi").select("task_id")


def shared_neighbours(edges: DataFrame, least: int) -> DataFrame:
    """Pairs of sources with at least `least` neighbours in common: a, b, shared. A stored table.

    Joined on the neighbour; meant for bounded in-degree or a `least` that the caller has pruned for.
    """
    e = edges.select("src", "dst").distinct()
    x, y = e.alias("x"), e.alias("y")
    pairs = x.join(y, (F.col("x.dst") == F.col("y.dst")) & (F.col("x.src") < F.col("y.src")))
    shared = pairs.groupBy(F.col("x.src").alias("a"), F.col("y.src").alias("b")).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    return cut(shared, "shared", rows=4 * edges.count())


def degree_hotspots(edges: DataFrame, k: int, alert: int) -> DataFrame:
    """Top k out- and in-degrees of each edge type: rel_type, side, node, degree, alert."""
    sides = [edges.groupBy("rel_type", F.col(c).alias("node")).agg(F.count("*").alias("degree")).withColumn("side", F.lit(s)) for c, s in (("src", "out"), ("dst", "in"))]
    both = sides[0].unionByName(sides[1])
    rank = F.row_number().over(Window.partitionBy("rel_type", "side").orderBy(F.desc("degree"), "node"))
    return both.withColumn("rn", rank).where(F.col("rn") <= k).select("rel_type", "side", "node", "degree", (F.col("degree") >= alert).alias("alert"))


#: Items of a group that meet in one task at most, about; larger groups are dealt out as pairs of blocks.
BLOCK = 2048


def cooccurrence(members: DataFrame, max_pairs: int | None = 45, least: int = 1) -> DataFrame:
    """Pairs of items (group_id, item) per group, at most max_pairs a group in order (None: all): a, b, n groups, `least` or more. A stored table.

    The first max_pairs ordered pairs of a group lie among its first
    max_pairs + 1 items, so only those are paired, however large the group.
    With None a group of over BLOCK items is cut into blocks, and each pair of
    blocks is a key of its own.
    """
    m = members.select("group_id", "item").distinct()
    if max_pairs is not None:
        place = F.row_number().over(Window.partitionBy("group_id").orderBy("item"))
        m = m.withColumn("place", place).where(F.col("place") <= max_pairs + 1).drop("place")
        rows, keys = 2 * members.count(), ["group_id"]
    else:
        sizes = m.groupBy("group_id").agg(F.count("*").alias("size"))
        made, largest = sizes.agg(F.sum(F.expr("size * (size - 1) div 2")), F.max("size")).first()
        rows, keys = made or 0, ["group_id"]
        if (largest or 0) > BLOCK:
            n = F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1))
            dealt = m.join(sizes.where(F.col("size") > BLOCK), "group_id", "left").select("group_id", "item", n.alias("blocks"), F.pmod(F.xxhash64("item"), n).alias("block"))
            dealt = dealt.select("group_id", "item", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            m = dealt.select("group_id", "item", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
            keys = ["group_id", "low", "high"]
    x, y = m.alias("x"), m.alias("y")
    met = reduce(lambda c, k: c & (F.col(f"x.{k}") == F.col(f"y.{k}")), keys, F.col("x.item") < F.col("y.item"))
    if len(keys) > 1:  # items of one block meet under its own key only
        met &= (F.col("x.low") == F.col("x.high")) | (F.col("x.block") != F.col("y.block"))
    pairs = x.join(y, met).select(F.col("x.group_id").alias("g"), F.col("x.item").alias("a"), F.col("y.item").alias("b"))
    if max_pairs is not None:
        rank = F.row_number().over(Window.partitionBy("g").orderBy("a", "b"))
        pairs = pairs.withColumn("rn", rank).where(F.col("rn") <= max_pairs)
    return cut(pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least), "pairs", rows=rows)


def unpromoted(pairs: DataFrame, named: DataFrame, least: int) -> DataFrame:
    """Co-occurring pairs of `least` groups or more that no named edge joins in either direction."""
    known = directed(named.select("src", "dst"), "both").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    return pairs.where(F.col("n") >= least).join(known, ["a", "b"], "left_anti")


def orphans(nodes: DataFrame, *inbound: DataFrame) -> DataFrame:
    """Nodes (node) that no edge of the given tables ends at."""
    ends = reduce(DataFrame.unionByName, [e.select(F.col("dst").alias("node")) for e in inbound]).distinct()
    return nodes.join(ends, "node", "left_anti")
