"""Queries of task graphs: declared dependencies, registration, snapshots, card context, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.operators import taskgraph
from mnemospark.sources.memory_tables import table


def _declared(spark, sf_dir):
    """A customer's orders as a graph: (tasks, dependencies in the order of declaration), many of them in cycles."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey")
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    tasks = o.select(F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").alias("task_id"), status.alias("status"), F.row_number().over(w.orderBy("o_orderkey")).alias("k"), F.count("*").over(w).alias("n"))
    waits = F.posexplode(F.array((F.col("k") * 3) % F.col("n") + 1, (F.col("k") * 5 + 2) % F.col("n") + 1)).alias("j", "k2")
    on = tasks.select("graph_id", F.col("task_id").alias("on_id"), F.col("k").alias("k2"))
    depends = tasks.select("graph_id", "task_id", waits).join(on, ["graph_id", "k2"]).select("graph_id", (F.col("task_id") * 2 + F.col("j")).alias("place"), "task_id", "on_id")
    return tasks.select("graph_id", "task_id", "status"), depends


def task_declared(spark, sf_dir):
    """Every proposed dependency, declared one after the other: accepted, or refused as it would close a cycle."""
    tasks, depends = _declared(spark, sf_dir)
    return taskgraph.register(tasks, depends)[1]


def task_ready(spark, sf_dir):
    """The ready list of every registered graph."""
    tasks, _ = taskgraph.register(*_declared(spark, sf_dir))
    return tasks.where("ready").select("graph_id", "task_id")


def task_cycle_paths(spark, sf_dir):
    """The way that each refused dependency would close, as text."""
    _, edges = taskgraph.register(*_declared(spark, sf_dir))
    ends = edges.select("place", F.col("task_id").alias("src"), F.col("on_id").alias("dst"), "accepted")
    paths = taskgraph.closing_paths(ends.where("NOT accepted"), ends.where("accepted"))
    return paths.select("place", F.array_join("path", " > ").alias("path"))


def task_cycle_checks(spark, sf_dir):
    """Would an order close a cycle if it waited for the next one? Over any number of accepted dependencies."""
    tasks, depends = _declared(spark, sf_dir)
    _, edges = taskgraph.register(tasks, depends)
    ahead = F.lead("task_id").over(Window.partitionBy("graph_id").orderBy("task_id"))
    pairs = tasks.select("graph_id", F.col("task_id").alias("src"), ahead.alias("dst")).where("dst IS NOT NULL")
    accepted = edges.where("accepted").select("graph_id", F.col("task_id").alias("src"), F.col("on_id").alias("dst"))
    return taskgraph.closes_cycle_graphs(accepted, pairs).select("src", "dst", "cycle")


def view_task_graph(spark, sf_dir):
    """Snapshots of all graphs: their tasks, and the edges that were accepted."""
    tasks, edges = taskgraph.register(*_declared(spark, sf_dir))
    return taskgraph.snapshot(tasks, edges.where("accepted"))


def _context(spark, sf_dir):
    """Context of every order over waits, and the orders of one clerk or one day of the customer."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    kinds = [("TASK_BLOCKS", F.lead("o_orderkey").over(w)), ("TASK_ENABLES", F.lead("o_orderkey", 3).over(w)), ("DEPENDS_ON", F.lead("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")))]
    ends = o.select(F.col("o_custkey").alias("graph_id"), "o_orderkey", *[c.alias(k) for k, c in kinds])
    made = ends.select("graph_id", F.col("o_orderkey").alias("src"), F.explode(F.array(*[F.struct(F.lit(k).alias("rel_type"), F.col(k).alias("dst")) for k, _ in kinds])).alias("e"))
    return made.select("graph_id", "src", "e.dst", "e.rel_type", F.concat_ws("-", "e.rel_type", "src", "e.dst").alias("edge_id")).where("dst IS NOT NULL")


def task_card_context(spark, sf_dir):
    """Five hops around every order at once, one edge a node, type and direction."""
    cards = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").alias("card"))
    return taskgraph.card_context_graphs(cards, _context(spark, sf_dir), max_hops=5, most=1).select("card", "edge_id", "hop", "direction")


def task_card_owners(spark, sf_dir):
    """Who is behind a card: the priorities of the orders that its context of two hops ends at, with their edges."""
    o = table(spark, sf_dir, "orders")
    found = taskgraph.card_context_graphs(o.select(F.col("o_custkey").alias("graph_id"), F.col("o_orderkey").alias("card")), _context(spark, sf_dir), max_hops=2, most=1)
    owners = o.select(F.col("o_orderkey").alias("dst"), F.col("o_orderpriority").alias("owner"))
    return found.join(owners, "dst").groupBy("card", "owner").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (task_declared, task_ready, task_cycle_paths, task_cycle_checks, view_task_graph, task_card_context, task_card_owners)}

#: Edge after edge, each graph's pairs of (task, what it waits for over any way) grow with the accepted ones.
_W = """WITH RECURSIVE t AS (SELECT o_custkey AS g, o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders
), e AS (SELECT a.g, a.task_id * 2 + j AS place, a.task_id AS src, b.task_id AS dst, row_number() OVER (PARTITION BY a.g ORDER BY a.task_id, j) AS i
  FROM t a, range(2) r(j), t b WHERE b.g = a.g AND b.k = CASE j WHEN 0 THEN (a.k * 3) % a.n + 1 ELSE (a.k * 5 + 2) % a.n + 1 END
), w(g, i, pairs, place, ok) AS (
  SELECT DISTINCT g, CAST(0 AS BIGINT), CAST([] AS BIGINT[][]), CAST(NULL AS BIGINT), false FROM t
  UNION ALL
  SELECT w.g, e.i, CASE WHEN e.src = e.dst OR list_contains(w.pairs, [e.dst, e.src]) THEN w.pairs ELSE list_distinct(list_concat(w.pairs, flatten(
    list_transform(list_append(list_transform(list_filter(w.pairs, lambda p: p[2] = e.src), lambda p: p[1]), e.src), lambda a:
      list_transform(list_append(list_transform(list_filter(w.pairs, lambda p: p[1] = e.dst), lambda p: p[2]), e.dst), lambda b: [a, b]))))) END,
    e.place, NOT (e.src = e.dst OR list_contains(w.pairs, [e.dst, e.src]))
  FROM w JOIN e ON e.g = w.g AND e.i = w.i + 1
), d AS (SELECT e.g AS graph_id, e.place, e.src AS task_id, e.dst AS on_id, w.ok AS accepted FROM w JOIN e ON e.g = w.g AND e.i = w.i)"""
_CONTEXT = """WITH RECURSIVE x AS (
  SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dst, 'TASK_BLOCKS' AS rel_type FROM orders
  UNION ALL SELECT o_orderkey, lead(o_orderkey, 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 'TASK_ENABLES' FROM orders
  UNION ALL SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey), 'DEPENDS_ON' FROM orders
), e AS (SELECT *, rel_type || '-' || src || '-' || dst AS edge_id FROM x WHERE dst IS NOT NULL
), b AS (SELECT edge_id, rel_type, 'out' AS direction, src AS node, dst AS other, dst FROM e UNION ALL SELECT edge_id, rel_type, 'in', dst, src, dst FROM e
), s AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY node, rel_type, direction ORDER BY edge_id) <= 1
), w(card, node, hop) AS (SELECT o_orderkey, o_orderkey, 0 FROM orders UNION SELECT w.card, s.other, w.hop + 1 FROM w JOIN s ON s.node = w.node WHERE w.hop < {hops} - 1
), c AS (SELECT w.card, s.edge_id, CAST(w.hop + 1 AS INTEGER) AS hop, s.direction, s.dst, row_number() OVER (PARTITION BY w.card, s.edge_id ORDER BY w.hop, s.direction, s.node) AS rn FROM w JOIN s ON s.node = w.node)"""

ORACLE_SQL = {
    "task_declared": _W + " SELECT * FROM d",
    "task_ready": _W + " SELECT g AS graph_id, task_id FROM t WHERE status = 'pending' AND task_id NOT IN (SELECT d.task_id FROM d JOIN t o ON o.task_id = d.on_id WHERE accepted AND o.status <> 'complete')",
    "task_cycle_checks": _W + """, last AS (SELECT g, arg_max(pairs, i) AS pairs FROM w GROUP BY g), p AS (SELECT g, task_id AS src, lead(task_id) OVER (PARTITION BY g ORDER BY task_id) AS dst FROM t)
SELECT src, dst, list_contains(pairs, [dst, src]) AS cycle FROM p JOIN last USING (g) WHERE dst IS NOT NULL""",
    "view_task_graph": _W + """ SELECT g AS graph_id, 'task' AS kind, task_id, NULL AS on_id, status FROM t
UNION ALL SELECT DISTINCT graph_id, 'edge', task_id, on_id, NULL FROM d WHERE accepted""",
    "task_card_context": _CONTEXT.format(hops=5) + " SELECT card, edge_id, hop, direction FROM c WHERE rn = 1",
    "task_card_owners": _CONTEXT.format(hops=2) + " SELECT card, o_orderpriority AS owner, count(*) AS n FROM c JOIN orders ON o_orderkey = c.dst WHERE rn = 1 GROUP BY card, owner",
}
