"""Queries over the typed graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.operators import graph
from mnemospark.sources.memory_tables import EDGES_SQL, edges, table


def _start(spark, node):
    return spark.createDataFrame([(node,)], "node string")


def graph_khop_forward(spark, sf_dir):
    return graph.reach(edges(spark, sf_dir), _start(spark, "r0"), 3)


def graph_impact_of(spark, sf_dir):
    """Reverse impact of a part: orders, customers, nations, regions with the fewest hops."""
    return graph.reach(edges(spark, sf_dir), _start(spark, "p1"), 4, "in")


def graph_lineage(spark, sf_dir):
    """Reverse lineage of the orders of a part, with the customer's segment as approver."""
    back = graph.reach(edges(spark, sf_dir).where("rel_type <> 'CONTAINS'"), _start(spark, "s1"), 6, "in")
    approvers = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_mktsegment").alias("approved_by"))
    return back.join(approvers, "node", "left")


def graph_permitted_paths(spark, sf_dir):
    """What a nation reaches at the public tier; customers of one segment are constrained to another."""
    policies = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.when(F.col("c_mktsegment") == "BUILDING", "elevated").alias("mode"))
    return graph.permitted(edges(spark, sf_dir), "n3", "public", policies, 4, ("CONTAINS", "INVOKES", "REQUIRES"))


def graph_explore(spark, sf_dir):
    found = graph.explore(edges(spark, sf_dir), "n3", 3)
    return found.select("node", "depth", "parent", "path_strength", F.array_join("path", ">").alias("path"))


def graph_explain_path(spark, sf_dir):
    """Provenance of the edges between nations and customers, with distinct policies of the source."""
    e = edges(spark, sf_dir).where("rel_type = 'INVOKES'")
    policies = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.col("c_mktsegment").alias("policy"))
    joined = e.join(policies, "src", "left")
    return joined.groupBy("src").agg(F.count("*").alias("n_edges"), F.array_join(F.sort_array(F.collect_set("policy")), ",").alias("policies"), F.round(F.avg(F.coalesce("confidence", F.lit(1.0))), 6).alias("confidence"))


def graph_cycle_check(spark, sf_dir):
    """Would an edge from a supplier back to a nation close a cycle?"""
    e = edges(spark, sf_dir)
    return graph.has_cycle_through(e, "s1", "n3", 5).unionByName(graph.has_cycle_through(e, "n3", "s1", 5))


def _tasks(spark, sf_dir):
    """A customer's orders as tasks: the k-th depends on the k/2-th and the k/3-th, directly."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    placed = o.select(F.col("o_orderkey").alias("task_id"), status.alias("status"), "o_custkey", place.alias("place"))
    on = F.explode(F.array_distinct(F.array(F.floor(F.col("place") / 2), F.floor(F.col("place") / 3)))).alias("on_place")
    direct = placed.select("task_id", "o_custkey", on).join(placed.select("o_custkey", F.col("place").alias("on_place"), F.col("task_id").alias("on_id")), ["o_custkey", "on_place"])
    return placed.select("task_id", "status"), direct.select("task_id", "on_id")


def graph_ready_tasks(spark, sf_dir):
    tasks, depends = _tasks(spark, sf_dir)
    return graph.ready(tasks, depends, ("complete", "skipped"))


def graph_blocked_dependents(spark, sf_dir):
    """Pending tasks downstream of a failed one."""
    return graph.blocked(*_tasks(spark, sf_dir))


def graph_shared_neighbours(spark, sf_dir):
    """Suppliers that deliver many of the same parts."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return graph.shared_neighbours(e, 60)


def graph_degree_hotspots(spark, sf_dir):
    return graph.degree_hotspots(edges(spark, sf_dir), 10, 500)


def _part_pairs(spark, sf_dir, max_pairs):
    return graph.cooccurrence(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("item")), max_pairs, least=2)


def graph_cooccurrence(spark, sf_dir):
    """Pairs of parts in two orders or more, whatever the size of an order."""
    return _part_pairs(spark, sf_dir, None)


def graph_unpromoted_pairs(spark, sf_dir):
    """Pairs of parts often ordered together but not of one brand (the named relation)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    pairs = _part_pairs(spark, sf_dir, 45)
    x, y = p.alias("x"), p.alias("y")
    often = pairs.join(x, F.col("a") == F.col("x.p_partkey")).join(y, F.col("b") == F.col("y.p_partkey"))
    named = often.where("x.p_brand = y.p_brand").select(F.col("b").alias("src"), F.col("a").alias("dst"))
    return graph.unpromoted(pairs, named, 2)


def graph_orphans(spark, sf_dir):
    """Customers whom no urgent order and no large one points at."""
    o = table(spark, sf_dir, "orders").withColumn("dst", F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return graph.orphans(c, o.where("o_orderpriority = '1-URGENT'"), o.where("o_totalprice > 400000"))


QUERIES = {f.__name__: f for f in (graph_khop_forward, graph_impact_of, graph_lineage, graph_permitted_paths, graph_explore, graph_explain_path, graph_cycle_check, graph_ready_tasks, graph_blocked_dependents, graph_shared_neighbours, graph_degree_hotspots, graph_cooccurrence, graph_unpromoted_pairs, graph_orphans)}


def _walk(start: str, hops: int, a: str = "src", b: str = "dst", where: str = "true") -> str:
    return f"""WITH RECURSIVE {EDGES_SQL}, w(node, hops) AS (
  SELECT '{start}', 0 UNION SELECT e.{b}, hops + 1 FROM w JOIN edges e ON e.{a} = w.node WHERE hops < {hops} AND {where})"""


_TASKS = """WITH tasks AS (SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders
), depends AS (SELECT a.task_id, b.task_id AS on_id, b.status AS on_status FROM tasks a JOIN tasks b ON a.o_custkey = b.o_custkey AND b.place IN (a.place // 2, a.place // 3))"""
_PAIRS = """WITH m AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS item FROM lineitem
), p AS (SELECT x.g, x.item AS a, y.item AS b, row_number() OVER (PARTITION BY x.g ORDER BY x.item, y.item) AS rn FROM m x JOIN m y ON x.g = y.g AND x.item < y.item
), n AS (SELECT a, b, count(*) AS n FROM p WHERE rn <= 45 GROUP BY a, b)"""
_LEAST = " SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM w WHERE hops > 0 GROUP BY node"

ORACLE_SQL = {
    "graph_khop_forward": _walk("r0", 3) + _LEAST,
    "graph_impact_of": _walk("p1", 4, "dst", "src") + _LEAST,
    "graph_lineage": _walk("s1", 6, "dst", "src", "e.rel_type <> 'CONTAINS'") + f", l AS ({_LEAST}) SELECT node, hops, c_mktsegment AS approved_by FROM l LEFT JOIN customer ON node = 'c' || c_custkey",
    "graph_permitted_paths": f"""WITH RECURSIVE {EDGES_SQL}, bad AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_mktsegment = 'BUILDING'
), w(node, hops, blocked) AS (SELECT 'n3', 0, false UNION
  SELECT e.dst, hops + 1, blocked OR e.dst IN (SELECT node FROM bad) FROM w JOIN edges e ON e.src = w.node WHERE hops < 4
), g AS (SELECT node, hops, bool_or(blocked) AS blocked FROM w WHERE hops > 0 GROUP BY node, hops)
SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM g WHERE NOT blocked GROUP BY node""",
    "graph_explore": f"""WITH {EDGES_SQL}, s AS (SELECT src, dst, max(coalesce(confidence, 1.0)) AS w FROM edges GROUP BY src, dst
), l1 AS (SELECT dst AS node, src AS parent, src || '>' || dst AS path, w AS total FROM s WHERE src = 'n3'
), l2 AS (SELECT dst AS node, min_by(src, src) AS parent, min_by(path || '>' || dst, src) AS path, min_by(total + w, src) AS total FROM l1 JOIN s ON s.src = l1.node GROUP BY dst
), l3 AS (SELECT dst AS node, min_by(src, src) AS parent, min_by(path || '>' || dst, src) AS path, min_by(total + w, src) AS total FROM l2 JOIN s ON s.src = l2.node GROUP BY dst)
SELECT node, 1 AS depth, parent, round(total, 3) AS path_strength, path FROM l1 UNION ALL SELECT node, 2, parent, round(total / 2, 3), path FROM l2
UNION ALL SELECT node, 3, parent, round(total / 3, 3), path FROM l3""",
    "graph_explain_path": """SELECT 'c' || o_custkey AS src, count(*) AS n_edges, string_agg(DISTINCT c_mktsegment, ',') AS policies,
  round(avg(CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey % 10 / 10.0 ELSE 1.0 END), 6) AS confidence FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey""",
    "graph_cycle_check": _walk("n3", 5) + " SELECT count(*) > 0 AS cycle FROM w WHERE node = 's1' AND hops > 0 UNION ALL SELECT false",
    "graph_ready_tasks": _TASKS + " SELECT task_id, status FROM tasks t WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM depends d WHERE d.task_id = t.task_id AND on_status <> 'complete')",
    "graph_blocked_dependents": _TASKS.replace("WITH", "WITH RECURSIVE", 1) + """, w AS (SELECT task_id FROM depends WHERE on_status = 'failed' UNION SELECT d.task_id FROM w JOIN depends d ON d.on_id = w.task_id)
SELECT task_id FROM tasks WHERE status = 'pending' AND task_id IN (SELECT task_id FROM w)""",
    "graph_shared_neighbours": """WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)
SELECT x.s AS a, y.s AS b, count(*) AS shared FROM e x JOIN e y ON x.p = y.p AND x.s < y.s GROUP BY x.s, y.s HAVING count(*) >= 60""",
    "graph_degree_hotspots": f"""WITH {EDGES_SQL}, d AS (SELECT rel_type, 'out' AS side, src AS node, count(*) AS degree FROM edges GROUP BY ALL
  UNION ALL SELECT rel_type, 'in', dst, count(*) FROM edges GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY rel_type, side ORDER BY degree DESC, node) AS rn FROM d)
SELECT rel_type, side, node, degree, degree >= 500 AS alert FROM r WHERE rn <= 10""",
    "graph_cooccurrence": """WITH m AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS item FROM lineitem)
SELECT x.item AS a, y.item AS b, count(*) AS n FROM m x JOIN m y ON x.g = y.g AND x.item < y.item GROUP BY x.item, y.item HAVING count(*) >= 2""",
    "graph_unpromoted_pairs": _PAIRS + " SELECT n.* FROM n JOIN part x ON a = x.p_partkey JOIN part y ON b = y.p_partkey WHERE n >= 2 AND x.p_brand <> y.p_brand",
    "graph_orphans": "SELECT 'c' || c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_totalprice > 400000)",
}
