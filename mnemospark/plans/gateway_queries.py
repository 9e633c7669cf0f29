"""Named queries with bound parameters, and tables upserted in versions, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators import plans
from mnemospark.sources.gateway import Gateway, NamedQuery
from mnemospark.sources.memory_tables import table
from mnemospark.sources.versioned import Tables, Upsert
from mnemospark.storage import shared_path

_NAMED = (
    NamedQuery("orders_of_segment", "SELECT o_orderkey, c_custkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = :segment AND o_totalprice >= :least AND o_orderstatus <> :status", {"segment": "string", "least": "double", "status": "string"}),
    NamedQuery("shared_suppliers", "WITH s AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_quantity > :quantity GROUP BY l_suppkey) SELECT l_suppkey, parts FROM s WHERE parts >= :parts", {"quantity": "long", "parts": "long"}),
)


def _gateway(spark, sf_dir) -> Gateway:
    gate = Gateway(spark, {t: table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem")})
    for query in _NAMED:
        gate.register(query)
    return gate


def named_orders(spark, sf_dir):
    return _gateway(spark, sf_dir).run("orders_of_segment", segment="BUILDING", least=100000.0, status="F")


def named_suppliers(spark, sf_dir):
    return _gateway(spark, sf_dir).run("shared_suppliers", quantity=10, parts=5)


def named_raw(spark, sf_dir):
    return _gateway(spark, sf_dir).raw("SELECT o_custkey, max(o_totalprice) AS most FROM orders WHERE o_orderpriority = :priority GROUP BY o_custkey", "largest orders for a review", priority="1-URGENT")


def _turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", "text")


def _registered(spark, sf_dir) -> Tables:
    """Plans of all sessions, declared three times: half of the sessions, all of them, and all again."""
    store = Tables(spark, shared_path(spark, "plans"))
    found = plans.detected(_turns(spark, sf_dir))
    for part in (found.where("session_id % 2 = 0"), found, found):
        store.commit(plans.plan_graph(part))
    return store


def plan_registered(spark, sf_dir):
    return _registered(spark, sf_dir).read("plans").select("plan_id", "session_id", "at", "n_steps", "declared")


def plan_edges(spark, sf_dir):
    """How many edges of each kind every plan has in the graph."""
    store = _registered(spark, sf_dir)
    edges, steps = store.read("plan_edges"), store.read("plan_steps").select(F.col("step_id").alias("src"), "plan_id")
    return edges.join(steps, "src").groupBy("plan_id", "rel_type").agg(F.count("*").alias("n"))


def artifact_upserts(spark, sf_dir):
    """Orders and their lines as run and step records: loaded, loaded again with other prices, and again: state and versions."""
    store = Tables(spark, shared_path(spark, "artifacts"))
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("task_id"), F.col("o_orderstatus").alias("status"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("part")).agg(F.sum("l_quantity").cast("long").alias("quantity"))
    late = runs.withColumn("status", F.when(F.col("run_id") % 4 == 0, F.lit("late")).otherwise(F.col("status")))
    for r, s in ((runs.where("run_id % 3 > 0"), lines.where("run_id % 3 > 0")), (late, lines), (late, lines)):
        store.commit({"runs": Upsert(r, ["run_id"]), "steps": Upsert(s, ["run_id", "part"])})
    parts = [store.read("runs", v).groupBy("status").agg(F.count("*").alias("n")).select(F.lit(v).alias("version"), "status", "n") for v in range(1, store.version() + 1)]
    steps = store.read("steps").groupBy("run_id").agg(F.sum("quantity").alias("quantity"))
    final = store.read("runs").join(steps, "run_id").select(F.lit(0).alias("version"), F.concat_ws("-", "status", "run_id").alias("status"), F.col("quantity").alias("n"))
    return reduce(DataFrame.unionByName, [*parts, final])


QUERIES = {f.__name__: f for f in (named_orders, named_suppliers, named_raw, plan_registered, plan_edges, artifact_upserts)}

_PLANS = r"""WITH t AS (SELECT conv_id AS session_id, turn, role, text, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS goal FROM conversations
), b AS (SELECT session_id, turn AS "at", list_filter(list_transform(string_split_regex(text, '[.!?\n]'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: length(s) >= 3) AS raw FROM t WHERE role = 'assistant'
), s AS (SELECT session_id, "at", list_filter(raw, lambda x, i: list_position(list_transform(raw, lambda y: lower(y)), lower(x)) = i) AS steps FROM b
), p AS (SELECT *, sha256(array_to_string(list_transform(steps, lambda x: lower(x)), chr(10))) AS plan_id, len(steps) AS n_steps FROM s WHERE len(steps) >= 2
), f AS (SELECT plan_id, session_id, "at", CAST(n_steps AS INTEGER) AS n_steps, count(*) OVER (PARTITION BY plan_id) AS declared FROM p QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY "at", session_id) = 1)"""

ORACLE_SQL = {
    "named_orders": "SELECT o_orderkey, c_custkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice >= 100000 AND o_orderstatus <> 'F'",
    "named_suppliers": "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_quantity > 10 GROUP BY l_suppkey HAVING parts >= 5",
    "named_raw": "SELECT o_custkey, max(o_totalprice) AS most FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey",
    "plan_registered": _PLANS + " SELECT * FROM f",
    "plan_edges": _PLANS + " SELECT plan_id, 'STEP_OF' AS rel_type, CAST(n_steps AS BIGINT) AS n FROM f UNION ALL SELECT plan_id, 'NEXT_STEP', n_steps - 1 FROM f WHERE n_steps > 1",
    "artifact_upserts": """WITH l AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'late' ELSE o_orderstatus END AS status FROM orders)
SELECT 1 AS version, o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderkey % 3 > 0 GROUP BY ALL
UNION ALL SELECT 2, status, count(*) FROM l GROUP BY ALL
UNION ALL SELECT 0, status || '-' || id, CAST(sum(l_quantity) AS BIGINT) FROM l JOIN lineitem ON l_orderkey = id GROUP BY ALL""",
}
