"""Queries of outcome reports, resolved ambiguities, anomalies, mechanics, manifests, snapshots, card targets and meta lessons, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.operators import updates
from mnemospark.sources.memory_tables import NODES_SQL, edges, nodes, table


def _reports(spark, sf_dir):
    """Line items as reports on their order's steps; those of every seventh part are on the whole plan and name the supplier as a procedure."""
    k = F.col("l_orderkey")
    whole = F.col("l_partkey") % 7 == 0
    return table(spark, sf_dir, "lineitem").select(
        k.alias("plan"), F.when(~whole, F.col("l_linenumber") % 3).alias("step"), F.when(F.col("l_linenumber") == 7, " ").otherwise(F.concat("l_linestatus", F.col("l_partkey").cast("string"))).alias("outcome"),
        F.when(F.col("l_quantity") != 13, ((F.col("l_quantity") - 20) / 16.0).cast("double")).alias("valence"), (k * 10 + F.col("l_linenumber")).alias("at"),
        F.when(F.col("l_returnflag") == "A", "system").when(F.col("l_returnflag") == "R", " ").alias("source"), F.when(whole, F.col("l_suppkey")).alias("procedure"),
        F.when(F.col("l_returnflag") == "R", F.col("l_tax") > 0.04).alias("worked"),
    )


def update_step_outcomes(spark, sf_dir):
    return updates.step_outcomes(_reports(spark, sf_dir), _acts_on(spark, sf_dir))[0]


def update_outcome_signals(spark, sf_dir):
    return updates.step_outcomes(_reports(spark, sf_dir), _acts_on(spark, sf_dir))[1]


def _acts_on(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan"), (F.col("l_linenumber") % 3).alias("step"), F.col("l_partkey").alias("concept"))


def update_plan_outcomes(spark, sf_dir):
    return updates.plan_outcomes(_reports(spark, sf_dir))


def update_procedure_stats(spark, sf_dir):
    k = F.col("s_suppkey")
    stored = table(spark, sf_dir, "supplier").select(k.alias("id"), F.when(k % 3 > 0, 10).alias("applied"), F.when(k % 3 > 0, k % 7).alias("succeeded"))
    return updates.procedure_stats(stored, _reports(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


def _ambiguous(spark, sf_dir):
    """Orders as pairs of customers that may be one concept, and the customers."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    resolution = F.when(k % 4 == 0, "merge").when(k % 4 == 1, "separate").when(k % 4 == 2, "skip").otherwise("other")
    events = o.select(k.alias("event"), F.col("o_custkey").alias("a"), (F.col("o_custkey") * 7 % 97 + 1).alias("b"), F.when(F.col("o_orderstatus") != "F", "pending").otherwise("merge").alias("status"), resolution.alias("resolution"))
    concepts = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 10).alias("created_at"), F.col("c_name").alias("text"), (F.col("c_nationkey") / 25.0).alias("strength"), (F.col("c_nationkey") == 3).alias("archived"))
    return events.where("a <> b"), concepts


def update_resolved_concepts(spark, sf_dir):
    made = updates.resolved_concepts(*_ambiguous(spark, sf_dir))
    return made.select("id", F.round("strength", 6).alias("strength"), "archived", "sure", F.array_join("labels", "|").alias("labels"))


def update_resolved_edges(spark, sf_dir):
    """Customers lead to the nation's number of their neighbours in the key order."""
    c = table(spark, sf_dir, "customer")
    kind = F.when(F.col("c_nationkey") % 3 == 0, "REQUIRES").when(F.col("c_nationkey") % 3 == 1, "EXTENDS").otherwise("SEEN")
    return updates.resolved_edges(*_ambiguous(spark, sf_dir), c.select(F.col("c_custkey").alias("src"), (F.col("c_custkey") * 11 % 89 + 1).alias("dst"), kind.alias("rel_type")))


def update_anomalies(spark, sf_dir):
    e, n, r = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    flags = e.select(F.col("user_id").alias("node"), (F.col("event_id") % 30).alias("constraint"), F.col("event_type").alias("anomaly"), F.col("value").alias("confidence"), F.col("event_id").alias("at"))
    return updates.flag_anomalies(flags, n.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"), F.col("c_name").alias("text")), r.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("text")))


def update_published_mechanics(spark, sf_dir):
    """Line items as summaries of one mechanic a part type and brand; parts of size 1 are stored."""
    p, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    told = line.join(p, F.col("l_partkey") == F.col("p_partkey")).select(updates.mechanic_id(F.col("p_type"), F.col("p_brand"), F.lit(None).cast("string")).alias("mechanic"), F.when(F.col("l_returnflag") != "A", F.concat("l_returnflag", "l_linestatus")).otherwise("").alias("task"), F.when(F.col("l_tax") > 0, F.col("l_discount")).cast("double").alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    stored = p.where("p_size = 1").select(updates.mechanic_id(F.col("p_type"), F.col("p_brand"), F.lit(None).cast("string")).alias("mechanic"), F.lit(5).alias("evidence"), F.array(F.lit("NO"), F.lit("x")).alias("tasks")).distinct()
    return updates.publish_mechanics(stored, told).withColumn("tasks", F.array_join("tasks", ","))


def recall_mechanic_priors(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    mechanics = c.select(F.col("c_custkey").alias("mechanic"), (F.col("c_nationkey") / 25.0).alias("confidence"), (F.col("c_custkey") % 5).alias("updated_at"))
    found = updates.recall_mechanics(mechanics, o.select(F.col("o_custkey").alias("mechanic"), F.col("o_orderpriority").alias("pattern")), 0.5, 20)
    return found.withColumn("patterns", F.array_join("patterns", "|"))


def update_trigger_manifest(spark, sf_dir):
    p, d = table(spark, sf_dir, "part"), table(spark, sf_dir, "documents")
    k, i = F.col("p_partkey"), F.col("doc_id")
    procedures = p.select(k.alias("id"), F.col("p_name").alias("name"), F.when(k % 3 > 0, F.col("p_type")).alias("description"), F.array("p_brand", F.col("p_size").cast("string"), "p_type", "p_name").alias("steps"), F.when(k % 4 > 0, F.col("p_brand")).otherwise("").alias("pattern"), F.col("p_size").cast("double").alias("strength"), (k % 7 == 0).alias("archived"))
    lessons = d.select(i.alias("id"), F.when(i % 3 == 0, "rule").when(i % 3 == 1, "").alias("kind"), "text", F.when(i % 5 > 0, F.col("source")).alias("pattern"), (i % 9).cast("double").alias("strength"), (i % 7 == 0).alias("archived"))
    made = updates.trigger_manifest(procedures, lessons, 60)
    return made.select("id", "source_type", "name", "pattern", "strength", F.sha2("snippet", 256).alias("snippet_sha256"))


def session_snapshots(spark, sf_dir):
    """Customers as sessions, their orders as decisions and as files."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    k = F.col("c_custkey")
    goal = F.when(k % 3 == 0, F.concat(F.lit("Do B"), k.cast("string"), F.lit(" for "), "c_name")).when(k % 3 == 1, F.concat(F.col("c_name"), F.lit(" and "), F.repeat(F.col("c_mktsegment"), 15)))
    decisions = o.select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 8 > 0, F.repeat(F.col("o_orderpriority"), 15)).otherwise("").alias("text"), (F.col("o_orderstatus") == "P").alias("archived"), F.col("o_totalprice").alias("at"))
    files = o.select(F.col("o_custkey").alias("session"), F.col("o_orderkey").cast("string").alias("path"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("title"), F.col("o_orderkey").alias("at"))
    made = updates.snapshots(c.select(k.alias("session"), goal.alias("goal")), decisions, files)
    return made.select("session", F.sha2("snapshot", 256).alias("snapshot_sha256"))


_TARGETS = ("STANDARD", "ASIA", "EUR", "GERMANY", "nowhere")


def card_targets(spark, sf_dir):
    """Regions and nations as cards, nations as branches too."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    cards = r.select(F.lit("MainQuest").alias("type"), F.lit(0).alias("rank"), F.col("r_regionkey").alias("id"), F.col("r_name").alias("text"))
    cards = cards.union(n.where("n_nationkey % 2 = 0").select(F.lit("SideQuest"), F.lit(1), F.col("n_nationkey"), "n_name"))
    branches = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return reduce(lambda a, b: a.union(b), [updates.card_target(cards, branches, t).withColumn("target", F.lit(t)) for t in _TARGETS])


def _clusters(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return n.select(F.col("node_id").alias("id"), F.concat_ws("-", F.col("label").cast("string"), (F.col("node_id") % 6).cast("string")).alias("cluster"), "strength", F.when(F.col("node_id") % 10 > 0, F.col("confidence")).alias("confidence"))


def life_meta_lessons(spark, sf_dir):
    """Clusters given by label and id, so that SQL can follow; `life_leader_clusters` makes them from vectors."""
    c = _clusters(spark, sf_dir)
    made = updates.meta_lessons(c, c)[0]
    return made.select("cluster", "size", F.round("strength", 6).alias("strength"), F.round("confidence", 6).alias("confidence"))


def life_meta_lesson_parts(spark, sf_dir):
    c = _clusters(spark, sf_dir)
    return updates.meta_lessons(c, c)[1].select("id", F.round("strength", 6).alias("strength"))


def life_avoidance(spark, sf_dir):
    """Clusters of messages, given by session and role."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 10000 + F.col("turn")).alias("id"), F.concat_ws("-", F.col("conv_id").cast("string"), "role").alias("cluster"), F.when(F.col("turn") != 1, F.col("text")).alias("text"), (F.col("turn") % 5 / 4.0 + 1).alias("salience"))
    placed = c.select("id", "cluster", F.row_number().over(Window.partitionBy("cluster").orderBy("id")).alias("rn"))
    made = updates.avoidance(placed, c)
    return made.select("cluster", F.sha2("name", 256).alias("name_sha256"), F.round("confidence", 6).alias("confidence"), F.round("strength", 6).alias("strength"), F.sha2(F.array_join("warnings", "|"), 256).alias("warnings_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        update_step_outcomes, update_outcome_signals, update_plan_outcomes, update_procedure_stats, update_resolved_concepts, update_resolved_edges, update_anomalies, update_published_mechanics,
        recall_mechanic_priors, update_trigger_manifest, session_snapshots, card_targets, life_meta_lessons, life_meta_lesson_parts, life_avoidance,
    )
}

_REPORTS = """reports AS (SELECT l_orderkey AS plan, CASE WHEN l_partkey % 7 <> 0 THEN l_linenumber % 3 END AS step, l_linestatus || l_partkey AS outcome, greatest(-1, least(1, CAST((l_quantity - 20) / 16.0 AS DOUBLE))) AS valence,
  l_orderkey * 10 + l_linenumber AS w, CASE WHEN l_returnflag = 'A' THEN 'system' ELSE 'explicit' END AS source, CASE WHEN l_partkey % 7 = 0 THEN l_suppkey END AS procedure, CASE WHEN l_returnflag = 'R' THEN l_tax > 0.04 END AS worked
  FROM lineitem WHERE l_linenumber <> 7 AND l_quantity <> 13)"""
_EVENTS = """c AS (SELECT c_custkey AS id, c_custkey % 10 AS created_at, c_name AS text, c_nationkey / 25.0 AS strength, c_nationkey = 3 AS archived FROM customer),
  e AS (SELECT o_custkey AS a, o_custkey * 7 % 97 + 1 AS b, o_orderkey % 4 AS k FROM orders WHERE o_orderstatus <> 'F' AND o_custkey <> o_custkey * 7 % 97 + 1),
  p AS (SELECT k, a, b, CASE WHEN x.created_at <= y.created_at THEN a ELSE b END AS canonical, CASE WHEN x.created_at <= y.created_at THEN b ELSE a END AS duplicate, CASE WHEN x.created_at <= y.created_at THEN y.text ELSE x.text END AS label FROM e JOIN c x ON x.id = a JOIN c y ON y.id = b)"""
_SNIPPET = """CASE WHEN length(w) <= 60 THEN w WHEN instr(substr(w, 1, 60), '.') > 0 AND 60 - instr(reverse(substr(w, 1, 60)), '.') > 30 THEN substr(w, 1, 60 - instr(reverse(substr(w, 1, 60)), '.') + 1) ELSE rtrim(substr(w, 1, 60)) || '...' END"""
_CLUSTERS = f"{NODES_SQL}, k AS (SELECT node_id AS id, label || '-' || node_id % 6 AS cluster, strength, CASE WHEN node_id % 10 > 0 THEN confidence ELSE 0 END AS confidence FROM nodes)"

ORACLE_SQL = {
    "update_step_outcomes": f"""WITH {_REPORTS}, t AS (SELECT plan, step, max(struct_pack(w := w, valence := valence, outcome := outcome)) AS r FROM reports WHERE step IS NOT NULL GROUP BY ALL)
  SELECT plan, step, r.outcome AS outcome, r.valence AS valence, CASE WHEN r.valence >= 0 THEN 'succeeded' ELSE 'failed' END AS status FROM t""",
    "update_outcome_signals": f"""WITH {_REPORTS}, bad AS (SELECT plan, step, max(struct_pack(w := w, valence := valence)).valence AS valence FROM reports WHERE step IS NOT NULL AND valence < 0 GROUP BY plan, step)
  SELECT plan, step, concept, valence FROM bad JOIN (SELECT DISTINCT l_orderkey AS plan, l_linenumber % 3 AS step, l_partkey AS concept FROM lineitem) USING (plan, step)""",
    "update_plan_outcomes": f"""WITH {_REPORTS}, t AS (SELECT plan, max(struct_pack(w := w, valence := valence, outcome := outcome, source := source)) AS r FROM reports WHERE step IS NULL GROUP BY plan)
  SELECT plan, r.outcome AS outcome, r.valence AS valence, r.source AS source, 'completed' AS status FROM t""",
    "update_procedure_stats": f"""WITH {_REPORTS}, n AS (SELECT procedure AS id, count(*) AS more, count(*) FILTER (coalesce(worked, valence >= 0)) AS good FROM reports WHERE procedure IS NOT NULL GROUP BY procedure),
  t AS (SELECT id, more + CASE WHEN id % 3 > 0 THEN 10 ELSE 0 END AS applied, good + CASE WHEN id % 3 > 0 THEN id % 7 ELSE 0 END AS succeeded FROM n JOIN supplier ON s_suppkey = id) SELECT id, applied, succeeded, round(succeeded / applied, 6) AS rate FROM t""",
    "update_resolved_concepts": f"""WITH {_EVENTS}, g AS (SELECT canonical AS id, 1 AS gain, false AS gone, true AS sure, label FROM p WHERE k = 0 UNION ALL SELECT duplicate, 0, true, false, NULL FROM p WHERE k = 0
  UNION ALL SELECT a, 0, false, true, NULL FROM p WHERE k = 1 UNION ALL SELECT b, 0, false, true, NULL FROM p WHERE k = 1)
  SELECT id, CAST(round(any_value(strength) + 0.15 * sum(gain), 6) AS DOUBLE) AS strength, any_value(archived) OR bool_or(gone) AS archived, bool_or(sure) AS sure, coalesce(string_agg(DISTINCT label, '|' ORDER BY label), '') AS labels FROM g JOIN c USING (id) GROUP BY id""",
    "update_resolved_edges": f"""WITH {_EVENTS}, d AS (SELECT c_custkey AS src, c_custkey * 11 % 89 + 1 AS dst, CASE c_nationkey % 3 WHEN 0 THEN 'REQUIRES' WHEN 1 THEN 'EXTENDS' ELSE 'SEEN' END AS rel_type FROM customer)
  (SELECT DISTINCT canonical AS src, dst, rel_type FROM d JOIN p ON p.duplicate = d.src WHERE k = 0 AND rel_type <> 'SEEN' AND dst <> canonical EXCEPT SELECT src, dst, rel_type FROM d) UNION ALL SELECT a, b, 'DISTINCT_FROM' FROM p WHERE k = 1""",
    "update_anomalies": """WITH l AS (SELECT user_id AS node, event_id % 30 AS con, arg_max(event_type, event_id) AS anomaly, max(struct_pack(i := event_id, v := value)).v AS confidence FROM events GROUP BY ALL)
  SELECT node, c_mktsegment AS type, c_name AS text, anomaly, round(coalesce(confidence, 0), 3) AS confidence, con AS constraint, n_name AS constraint_text FROM l JOIN customer ON c_custkey = node JOIN nation ON n_nationkey = con""",
    "update_published_mechanics": """WITH m AS (SELECT 'mech-' || substr(sha256(p_type || ':' || p_brand || ':'), 1, 24) AS mechanic, p_partkey, p_size FROM part),
  s AS (SELECT mechanic, CASE WHEN l_returnflag <> 'A' THEN l_returnflag || l_linestatus ELSE '' END AS task, coalesce(CASE WHEN l_tax > 0 THEN CAST(l_discount AS DOUBLE) END, 0.5) AS confidence, l_orderkey * 10 + l_linenumber AS w FROM lineitem JOIN m ON p_partkey = l_partkey),
  o AS (SELECT DISTINCT mechanic FROM m WHERE p_size = 1), t AS (SELECT mechanic, task, min(w) AS w FROM s WHERE task <> '' GROUP BY ALL),
  n AS (SELECT mechanic, string_agg(task, ',' ORDER BY w, task) AS new, string_agg(task, ',' ORDER BY w, task) FILTER (task <> 'NO') AS other FROM t GROUP BY mechanic)
  SELECT s.mechanic, max(struct_pack(w := w, confidence := confidence)).confidence AS confidence, count(*) + CASE WHEN any_value(o.mechanic) IS NULL THEN 0 ELSE 5 END AS evidence, CASE WHEN any_value(o.mechanic) IS NULL THEN coalesce(any_value(new), '') ELSE 'NO,x' || coalesce(',' || any_value(other), '') END AS tasks
  FROM s LEFT JOIN o USING (mechanic) LEFT JOIN n ON n.mechanic = s.mechanic GROUP BY s.mechanic""",
    "recall_mechanic_priors": """WITH t AS (SELECT row_number() OVER (ORDER BY c_nationkey DESC, c_custkey % 5 DESC, c_custkey) AS rank, c_custkey AS mechanic, CAST(c_nationkey / 25.0 AS DOUBLE) AS confidence FROM customer WHERE c_nationkey / 25.0 >= 0.5)
  SELECT rank, mechanic, confidence, coalesce((SELECT string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) FROM orders WHERE o_custkey = mechanic), '') AS patterns FROM t WHERE rank <= 20""",
    "update_trigger_manifest": f"""WITH u AS (SELECT p_partkey AS id, 'procedure' AS source_type, p_name AS name, p_brand AS pattern, CAST(p_size AS DOUBLE) AS strength,
  concat_ws(chr(10), p_name, CASE WHEN p_partkey % 3 > 0 THEN p_type END, '1. ' || p_brand, '2. ' || p_size, '3. ' || p_type) AS w FROM part WHERE p_partkey % 4 > 0 AND p_partkey % 7 > 0
  UNION ALL SELECT doc_id, 'lesson', CASE WHEN doc_id % 3 = 0 THEN 'Lesson (rule)' ELSE 'Lesson' END, source, CAST(doc_id % 9 AS DOUBLE), coalesce(text, '') FROM documents WHERE doc_id % 5 > 0 AND doc_id % 7 > 0 AND source <> '')
  SELECT id, source_type, name, pattern, strength, sha256({_SNIPPET}) AS snippet_sha256 FROM u""",
    "session_snapshots": """WITH g AS (SELECT c_custkey AS session, CASE c_custkey % 3 WHEN 0 THEN 'Do B' || c_custkey || ' for ' || c_name WHEN 1 THEN c_name || ' and ' || repeat(c_mktsegment, 15) END AS goal, CASE WHEN c_custkey % 3 = 0 THEN 'B' || c_custkey END AS card FROM customer),
  d AS (SELECT o_custkey AS session, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders WHERE o_orderstatus <> 'P'),
  ds AS (SELECT session, '**Recent decisions:**' || coalesce(string_agg(chr(10) || '- ' || substr(repeat(o_orderpriority, 15), 1, 120), '' ORDER BY rn) FILTER (o_orderkey % 8 > 0), '') AS decided FROM d WHERE rn <= 5 GROUP BY session),
  f AS (SELECT o_custkey AS session, o_orderkey || CASE WHEN o_orderstatus = 'F' THEN ' — ' || o_orderpriority ELSE '' END AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders),
  fs AS (SELECT session, '**Files in flight:**' || string_agg(chr(10) || '- ' || line, '' ORDER BY rn) AS files FROM f WHERE rn <= 10 GROUP BY session)
  SELECT session, sha256(concat_ws(chr(10), '**Active card:** ' || coalesce(card, substr(goal, 1, 30), 'No active card'), '**Goal:** ' || substr(goal, 1, 120), decided, files)) AS snapshot_sha256 FROM g LEFT JOIN ds USING (session) LEFT JOIN fs USING (session)""",
    "card_targets": "WITH t(target) AS (VALUES " + ", ".join(f"('{t}')" for t in _TARGETS) + """), c AS (SELECT CASE WHEN r_name = target THEN 0 ELSE 1 END AS tier, 0 AS rank, 'MainQuest' AS type, r_regionkey AS id, r_name = target AS same, target FROM region JOIN t ON contains(r_name, target)
  UNION ALL SELECT CASE WHEN n_name = target THEN 0 ELSE 1 END, 1, 'SideQuest', n_nationkey, n_name = target, target FROM nation JOIN t ON contains(n_name, target) WHERE n_nationkey % 2 = 0 UNION ALL SELECT 2, 0, 'Workspace', n_nationkey, NULL, target FROM nation JOIN t ON n_name = target)
  SELECT type, id, CASE WHEN same THEN 'exact' WHEN NOT same THEN 'lexical' ELSE 'branch' END AS how, target FROM c QUALIFY row_number() OVER (PARTITION BY target ORDER BY tier, rank, id) = 1""",
    "life_meta_lessons": f"WITH {_CLUSTERS} SELECT cluster, count(*) AS size, CAST(round(least(1, max(strength) * 1.2), 6) AS DOUBLE) AS strength, CAST(round(least(0.99, avg(confidence) + 0.05), 6) AS DOUBLE) AS confidence FROM k GROUP BY cluster",
    "life_meta_lesson_parts": f"WITH {_CLUSTERS} SELECT id, CAST(round(CAST(strength AS DOUBLE) / 1.3, 6) AS DOUBLE) AS strength FROM k WHERE cluster IS NOT NULL",
    "life_avoidance": """WITH m AS (SELECT conv_id || '-' || role AS cluster, CASE WHEN turn <> 1 THEN coalesce(text, '') ELSE '' END AS text, turn % 5 / 4.0 + 1 AS salience, row_number() OVER (PARTITION BY conv_id || '-' || role ORDER BY conv_id * 10000 + turn) AS rn FROM conversations)
  SELECT cluster, sha256('Avoid: ' || substr(max(text) FILTER (rn = 1), 1, 60)) AS name_sha256, CAST(round(least(avg(salience) / 1.6, 1), 6) AS DOUBLE) AS confidence, CAST(round(least(avg(salience) * 0.6, 1), 6) AS DOUBLE) AS strength,
  sha256(coalesce(string_agg('Avoid: ' || substr(text, 1, 100), '|' ORDER BY rn) FILTER (rn <= 5 AND text <> ''), '')) AS warnings_sha256 FROM m GROUP BY cluster""",
}
