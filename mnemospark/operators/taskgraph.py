"""Task graphs: dependencies declared in order, refused where they would close a cycle; snapshots and card context.

A dependency table is (src, dst): src waits for dst. Declaring edges one after
the other is sequential by its words, but only edges on cycles depend on each
other: everything else is peeled off first and accepted. What is left is
decided in rounds of one breadth-first search for all open edges together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from mnemospark.storage import cut


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def cyclic_core(edges: DataFrame) -> DataFrame:
    """The edges left when those that no edge leads to, or that lead to none, are peeled off until nothing changes.

    Every cycle is in the core. Each round is a stored table; there are as many
    as the longest chain outside the core is long.
    """
    core, before = cut(edges, "core"), -1
    while (n := core.count()) and n != before:
        before = n
        inner = core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        core = cut(inner.select(edges.columns), "core")
    return core


def _search(asked: DataFrame, steps: DataFrame) -> DataFrame:
    """For each asked edge (ask, src, dst, below): is there a way from dst to src over steps placed before `below`?

    steps: a, b, at, sure. Returns ask and pure (a way over sure steps alone).
    A node is visited once for each asked edge, and again only if it is then
    reached over sure steps.
    """
    level = cut(asked.select("ask", "src", "below", F.col("dst").alias("node"), F.lit(True).alias("whole")), "search")
    known = [level]
    while True:
        ahead = level.where("node <> src").join(steps, (F.col("node") == F.col("a")) & (F.col("at") < F.col("below")))
        moved = ahead.groupBy("ask", "src", "below", F.col("b").alias("node")).agg(F.bool_or(F.col("whole") & F.col("sure")).alias("whole"))
        seen = _union(known).groupBy("ask", "node").agg(F.bool_or("whole").alias("was"))
        fresh = moved.join(seen, ["ask", "node"], "left").where(F.col("was").isNull() | (F.col("whole") & ~F.col("was")))
        level = cut(fresh.select("ask", "src", "below", "node", "whole"), "search")
        if level.isEmpty():
            return _union(known).where("node = src").groupBy("ask").agg(F.bool_or("whole").alias("pure"))
        known.append(level)


def closing_paths(refused: DataFrame, accepted: DataFrame) -> DataFrame:
    """place and path: src and the fewest accepted steps of a smaller place from dst back to src, smallest predecessors first.

    refused and accepted: place, src, dst. A self edge has the path src > src.
    """
    steps = cut(accepted.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("place").alias("at")), "path-steps")
    level = cut(refused.select("place", "src", F.col("dst").alias("node"), F.array(F.col("src"), F.col("dst")).alias("path")), "paths")
    known = [level]
    while True:
        ahead = level.where("node <> src").join(steps, (F.col("node") == F.col("a")) & (F.col("at") < F.col("place")))
        first = ahead.groupBy("place", "src", F.col("b").alias("node")).agg(F.min_by("path", "a").alias("path"))
        fresh = first.join(_union(known).select("place", "node"), ["place", "node"], "left_anti")
        level = cut(fresh.select("place", "src", "node", F.concat("path", F.array("node")).alias("path")), "paths")
        if level.isEmpty():
            return _union(known).where("node = src").select("place", "path")
        known.append(level)


def declare(proposed: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """proposed (place, src, dst; places are distinct) with `accepted`, as if declared one after the other.

    An edge is refused if src = dst or if src can be reached from dst over
    existing edges (src, dst; acyclic) and edges accepted before it. Rows with
    a null end are refused; an edge declared again is accepted again. A stored
    table.
    """
    rows = proposed.select("place", "src", "dst")
    if existing is not None:
        rows = rows.unionByName(existing.select(F.lit(None).cast("long").alias("place"), "src", "dst"))
    whole = rows.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    core = cyclic_core(whole.groupBy("src", "dst", "place").agg(F.lit(1).alias("one")).drop("one"))
    old = core.where("place IS NULL").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(-(1 << 62)).alias("at"), F.lit(True).alias("sure"))
    open_, sure, refused = core.where("place IS NOT NULL").select("place", "src", "dst"), [], []
    while not open_.isEmpty():
        steps = [old, open_.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("place").alias("at"), F.lit(False).alias("sure"))]
        steps += [s.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("place").alias("at"), F.lit(True).alias("sure")) for s in sure]
        found = _search(open_.select(F.col("place").alias("ask"), "src", "dst", F.col("place").alias("below")), cut(_union(steps), "steps")).withColumnRenamed("ask", "place")
        told = cut(open_.join(found, "place", "left"), "told")
        sure.append(told.where("pure IS NULL").select("place", "src", "dst"))
        refused.append(told.where("pure").select("place"))
        open_ = told.where("NOT pure").select("place", "src", "dst")
    marked = proposed.withColumn("accepted", F.coalesce(F.col("src") != F.col("dst"), F.lit(False)))
    if refused:
        no = _union(refused).withColumn("no", F.lit(True))
        marked = marked.join(no, "place", "left").withColumn("accepted", F.col("accepted") & F.col("no").isNull()).drop("no")
    return cut(marked, "declared")


#: Graphs of so many dependencies at most are declared in one pass over their rows; larger ones level by level.
SMALL = 20_000


def _reaches(ahead: dict, start, goal) -> bool:
    seen, todo = {start}, [start]
    while todo:
        for node in ahead.get(todo.pop(), ()):
            if node == goal:
                return True
            if node not in seen:
                seen.add(node)
                todo.append(node)
    return False


def _in_order(batches):
    """Rows (graph_id, place, src, dst) sorted by graph and place, with `accepted`; holds one graph's accepted edges."""
    import pyarrow as pa

    graph, ahead = object(), {}
    for batch in batches:
        told = []
        for g, a, b in zip(batch.column("graph_id").to_pylist(), batch.column("src").to_pylist(), batch.column("dst").to_pylist(), strict=True):
            if g != graph:
                graph, ahead = g, {}
            ok = a is not None and b is not None and a != b and not _reaches(ahead, b, a)
            if ok:
                ahead.setdefault(a, []).append(b)
            told.append(ok)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.bool_())], names=[*batch.schema.names, "accepted"])


def _answered(batches):
    """The same for rows of place 0, edges, and of place 1, asked pairs: only the latter, with `accepted` false where they would close a cycle."""
    import pyarrow as pa

    graph, ahead = object(), {}
    for batch in batches:
        told = []
        for g, place, a, b in zip(*(batch.column(c).to_pylist() for c in ("graph_id", "place", "src", "dst")), strict=True):
            if g != graph:
                graph, ahead = g, {}
            if place:
                told.append(a is None or b is None or (a != b and not _reaches(ahead, b, a)))
            else:
                ahead.setdefault(a, []).append(b)
                told.append(None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.bool_())], names=[*batch.schema.names, "accepted"])


def _apart(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(the rows of each small graph that is alone, the rows of the other graphs or None). rows: graph_id, src, dst, ..., stored."""
    ends = rows.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).where("node IS NOT NULL")
    shared = ends.groupBy("node").agg(F.min("graph_id").alias("g"), F.max("graph_id").alias("h"), F.bool_or(F.col("graph_id").isNull()).alias("none")).where("g <> h OR none").select("node")
    open_ = ends.join(shared, "node", "left_semi").select("graph_id")
    large = rows.groupBy("graph_id").agg(F.count("*").alias("n")).where((F.col("n") > SMALL) | F.col("graph_id").isNull()).select("graph_id")
    other = cut(open_.unionByName(large).distinct(), "open-graphs")
    alone, rest = rows, None
    if not other.isEmpty():
        same = rows["graph_id"].eqNullSafe(other["graph_id"])
        alone, rest = rows.join(other, same, "left_anti"), rows.join(other, same, "left_semi")
    return alone, rest


def _by_graph(rows: DataFrame, run) -> tuple[DataFrame, DataFrame | None]:
    """(rows with `accepted` by run over each small graph that is alone, the rows of the other graphs or None). rows: graph_id, place, src, dst, stored."""
    alone, rest = _apart(rows)
    schema = StructType([*rows.schema.fields, StructField("accepted", BooleanType(), True)])
    return alone.repartition("graph_id").sortWithinPartitions("graph_id", "place").mapInArrow(run, schema), rest


def declare_graphs(proposed: DataFrame) -> DataFrame:
    """proposed (graph_id, place, src, dst) with `accepted`, as declare() has it. A stored table.

    Graphs that share no node with another and have SMALL edges at most are
    decided edge by edge, many in one task; the others by declare().
    """
    told, rest = _by_graph(cut(proposed.select("graph_id", "place", "src", "dst"), "proposed"), _in_order)
    if rest is not None:
        told = told.unionByName(declare(rest).select(*told.columns))
    return cut(told, "declared")


def closes_cycle_graphs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (graph_id, src, dst) with `cycle`, as closes_cycle() has it; small graphs that are alone in one pass. edges: graph_id, src, dst."""
    part = lambda frame, place: frame.select("graph_id", F.lit(place).alias("place"), "src", "dst")
    told, rest = _by_graph(cut(part(edges, 0).unionByName(part(pairs, 1)), "asked"), _answered)
    found = told.where("place = 1").select("graph_id", "src", "dst", (~F.col("accepted")).alias("cycle"))
    if rest is not None:
        found = found.unionByName(closes_cycle(rest.where("place = 0"), rest.where("place = 1").select("graph_id", "src", "dst")).select(*found.columns))
    return found


def closes_cycle(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (src, dst) with `cycle`: would the edge close one, over any number of edges (src, dst)?"""
    asked = pairs.select("src", "dst").distinct().select(F.struct("src", "dst").alias("ask"), "src", "dst", F.lit(1).alias("below"))
    steps = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct().select("a", "b", F.lit(0).alias("at"), F.lit(True).alias("sure")), "steps")
    found = _search(asked, steps).select("ask.src", "ask.dst", F.lit(True).alias("cycle"))
    return pairs.join(found, ["src", "dst"], "left").withColumn("cycle", F.coalesce("cycle", F.col("src") == F.col("dst"), F.lit(False)))


def register(tasks: DataFrame, depends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Task graphs from their declarations: (tasks with `ready`, dependencies with `accepted`).

    tasks: graph_id, task_id, status; depends: graph_id, place, task_id,
    on_id in the order of declaration. A pending task is ready if no accepted
    dependency of its waits for a task that is not complete or skipped.
    """
    edges = declare_graphs(depends.select("graph_id", "place", F.col("task_id").alias("src"), F.col("on_id").alias("dst")))
    waits = edges.where("accepted").select(F.col("src").alias("task_id"), F.col("dst").alias("on_id"))
    undone = tasks.where(~F.col("status").isin("complete", "skipped")).select(F.col("task_id").alias("on_id")).distinct()
    held = waits.join(undone, "on_id", "left_semi").select("task_id").distinct().withColumn("held", F.lit(True))
    marked = tasks.join(held, "task_id", "left").withColumn("ready", (F.col("status") == "pending") & F.col("held").isNull()).drop("held")
    return marked, edges.select("graph_id", "place", F.col("src").alias("task_id"), F.col("dst").alias("on_id"), "accepted")


def snapshot(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """A graph as rows: graph_id, kind (task or edge), task_id, on_id, status; an edge belongs to the graph of its first end."""
    nodes = tasks.select("graph_id", F.lit("task").alias("kind"), "task_id", F.lit(None).cast(tasks.schema["task_id"].dataType).alias("on_id"), "status")
    ends = edges.select("task_id", "on_id").distinct().join(tasks.select("graph_id", "task_id"), "task_id")
    return nodes.unionByName(ends.select("graph_id", F.lit("edge").alias("kind"), "task_id", "on_id", F.lit(None).cast("string").alias("status")))


def card_context(cards: DataFrame, edges: DataFrame, max_hops: int = 3, most: int = 25) -> DataFrame:
    """Dependency context of many cards at once: card, hop, rel_type, direction, src, dst, rank.

    cards: card. edges: edge_id, src, dst, rel_type. From each frontier node at
    most `most` edges of a type and direction are followed, by edge_id; an
    edge is listed once a card, at the first hop that met it, and a node leads
    on once a card.
    """
    both = [edges.select("edge_id", "rel_type", F.lit(d).alias("direction"), F.col(a).alias("node"), F.col(b).alias("other"), "src", "dst") for d, a, b in (("out", "src", "dst"), ("in", "dst", "src"))]
    # The quota is a node's, whatever the card: it is taken once, before any walk.
    place = F.row_number().over(Window.partitionBy("node", "rel_type", "direction").orderBy("edge_id"))
    steps = cut(_union(both).withColumn("rank", place).where(F.col("rank") <= most), "card-steps")
    level = cut(cards.select("card").distinct().withColumn("node", F.col("card")), "card-level")
    nodes, listed = [level], []
    for hop in range(1, max_hops + 1):
        met = level.join(steps, "node").groupBy("card", "edge_id").agg(F.min(F.struct("direction", "node", "rel_type", "src", "dst", "rank", "other")).alias("m"), F.collect_set("other").alias("ends"))
        if listed:
            met = met.join(_union(listed).select("card", "edge_id"), ["card", "edge_id"], "left_anti")
        met = cut(met.select("card", "edge_id", F.lit(hop).alias("hop"), "m.rel_type", "m.direction", "m.src", "m.dst", "m.rank", "ends"), "card-edges")
        listed.append(met)
        level = cut(met.select("card", F.explode("ends").alias("node")).distinct().join(_union(nodes), ["card", "node"], "left_anti"), "card-level")
        if level.isEmpty():
            break
        nodes.append(level)
    return _union(listed).drop("ends")


def _around(max_hops: int, most: int):
    """Tasks of card_context_graphs: rows (graph_id, edge_id, src, dst, rel_type) of whole graphs, those without an edge_id name a card."""
    import pyarrow as pa

    def told(cards, edges, schema):
        sides, out = {}, []
        for edge_id, src, dst, rel in sorted(edges, key=lambda e: e[0]):
            for direction, node, other in (("out", src, dst), ("in", dst, src)):
                same = sides.setdefault(node, {}).setdefault((rel, direction), [])
                if len(same) < most:
                    same.append((direction, node, edge_id, rel, src, dst, len(same) + 1, other))
        ways = {node: [w for same in by.values() for w in same] for node, by in sides.items()}
        for card in cards:
            level, seen, listed = [card], {card}, set()
            for hop in range(1, max_hops + 1):
                met, ends = {}, set()
                for node in level:
                    for w in ways.get(node, ()):
                        if w[2] not in listed:
                            ends.add(w[7])
                            if w[2] not in met or w < met[w[2]]:
                                met[w[2]] = w
                listed.update(met)
                out.extend((card, edge_id, hop, w[3], w[0], w[4], w[5], w[6]) for edge_id, w in met.items())
                level = ends - seen
                seen |= ends
                if not level:
                    break
            if len(out) >= 1 << 15:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema, strict=True)], names=_FOUND)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema, strict=True)], names=_FOUND)

    def run(batches):
        graph, cards, edges, schema = object(), set(), [], None
        for batch in batches:
            kind = {f.name: f.type for f in batch.schema}
            schema = [kind["src"], kind["edge_id"], pa.int32(), kind["rel_type"], pa.string(), kind["src"], kind["dst"], pa.int32()]
            for g, edge_id, src, dst, rel in zip(*(batch.column(c).to_pylist() for c in ("graph_id", "edge_id", "src", "dst", "rel_type")), strict=True):
                if g != graph:
                    yield from told(cards, edges, schema)
                    graph, cards, edges = g, set(), []
                if edge_id is None:
                    cards.add(src)
                else:
                    edges.append((edge_id, src, dst, rel))
        yield from told(cards, edges, schema) if schema else ()

    return run


_FOUND = ["card", "edge_id", "hop", "rel_type", "direction", "src", "dst", "rank"]


def card_context_graphs(cards: DataFrame, edges: DataFrame, max_hops: int = 3, most: int = 25) -> DataFrame:
    """card_context() of cards (graph_id, card) over edges (graph_id, edge_id, src, dst, rel_type; edge ids are distinct, no nulls).

    Graphs that share no node with another and have SMALL rows at most are
    walked whole in a task, all their cards at once; the others hop by hop.
    """
    asked = cards.select("graph_id", F.lit(None).cast(edges.schema["edge_id"].dataType).alias("edge_id"), F.col("card").alias("src"), F.col("card").alias("dst"), F.lit(None).cast(edges.schema["rel_type"].dataType).alias("rel_type"))
    rows = cut(edges.select("graph_id", "edge_id", "src", "dst", "rel_type").unionByName(asked), "context")
    alone, rest = _apart(rows)
    e = rows.schema
    schema = StructType([StructField("card", e["src"].dataType), StructField("edge_id", e["edge_id"].dataType), StructField("hop", IntegerType()), StructField("rel_type", e["rel_type"].dataType), StructField("direction", StringType()), StructField("src", e["src"].dataType), StructField("dst", e["dst"].dataType), StructField("rank", IntegerType())])
    found = alone.repartition("graph_id").sortWithinPartitions("graph_id").mapInArrow(_around(max_hops, most), schema)
    if rest is not None:
        found = found.unionByName(card_context(rest.where("edge_id IS NULL").select(F.col("src").alias("card")), rest.where("edge_id IS NOT NULL"), max_hops, most).select(*found.columns))
    return found
