"""Queries of audits, repairs, hindsight plans, types and reified concepts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import audit
from mnemospark.plans.text_queries import _VALENCE, SPOKEN_SQL, spoken
from mnemospark.sources.memory_tables import NODES_SQL, nodes, table


def _kind():
    k = F.col("o_orderkey") % 4
    return F.when(k == 0, "APPLIES_TO").when(k == 1, "CONTAINS_LESSON").when(k == 2, "LEARNED").otherwise("SEEN")


def audit_lesson_flags(spark, sf_dir):
    """Customers as lessons; a customer's orders lead from the customer or to it."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    k = F.col("c_custkey")
    lessons = c.select(k.alias("id"), (F.col("c_nationkey") == 3).alias("archived"), F.when(F.col("c_mktsegment") == "BUILDING", "synthesis").when(F.col("c_mktsegment") != "MACHINERY", "rule").alias("kind"), F.col("c_acctbal").alias("created_at"))
    a, b = F.col("o_custkey"), F.col("o_orderkey") + 10_000_000
    links = o.select(F.when(_kind() == "APPLIES_TO", a).otherwise(b).alias("src"), F.when(_kind() == "APPLIES_TO", b).otherwise(a).alias("dst"), _kind().alias("rel_type")).where("o_totalprice > 300000")
    return audit.flags(lessons, links, F.lit(4000.0))


def _outcome_texts(spark, sf_dir):
    said = spoken(spark, sf_dir)
    n = F.col("session_id") + F.col("turn")
    head = F.when(n % 2 == 0, "Plan outcome (success): ").when(n % 7 == 1, "Outcome: ").otherwise("Plan outcome (failure): ")
    mark = F.when(n % 5 == 0, "\n[valence_trigger: x]").otherwise("")
    return said.select(F.col("message_id").alias("id"), F.concat(head, F.col("text"), mark).alias("text"), (n % 9 == 0).alias("archived"))


def audit_polarity(spark, sf_dir):
    return audit.polarity_repairs(_outcome_texts(spark, sf_dir)).select("id", "action", "old", F.sha2("new_text", 256).alias("text_sha256"), "new_valence")


def audit_plan_valence(spark, sf_dir):
    """Sessions as plans, their messages as outcomes."""
    s = spoken(spark, sf_dir)
    k = F.col("session_id")
    plans = s.select("session_id").distinct().select(k.alias("id"), F.concat(F.lit("goal "), k.cast("string")).alias("goal"), F.when(k % 3 == 0, 0.5).when(k % 3 == 1, -0.5).alias("valence"), F.when(k % 4 == 0, "user").when(k % 4 == 1, "system").alias("source"), (k % 11 == 0).alias("archived"))
    return audit.plan_repairs(plans, s.select(k.alias("id"), F.col("turn").alias("number"), F.col("text").alias("outcome")))


def plan_retrospective(spark, sf_dir):
    """Messages as actions; a message's vector is the node of its session, plans are archived nodes of its label."""
    s, n = spoken(spark, sf_dir), nodes(spark, sf_dir)
    items = s.join(n.select(F.col("node_id").alias("session_id"), F.col("label").alias("domain"), "v"), "session_id").select(F.col("session_id").alias("session"), "domain", F.col("turn").alias("at"), "text", "v")
    made = audit.retrospective(items, n.where("archived").select(F.col("label").alias("domain"), "v"))
    return made.select("session", F.sha2("goal", 256).alias("goal_sha256"), F.sha2(F.array_join("steps", "|"), 256).alias("steps_sha256"))


def graph_temporal_context(spark, sf_dir):
    """Events of a user follow one another; the texts of the neighbours in time."""
    e = table(spark, sf_dir, "events")
    texts = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") != "error", F.coalesce("props", F.lit(""))).alias("text"))
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.when(F.col("o_orderstatus") == "F", "NEXT_MESSAGE").when(F.col("o_orderstatus") == "O", "CAUSED_BY").otherwise("SEEN").alias("rel_type"))
    return audit.temporal_context(texts, links).select("id", F.sha2(F.array_join("context", "|"), 256).alias("context_sha256"), F.size("context").alias("n"))


def concept_dictionary(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    entries = p.select(F.col("p_type").alias("name"), F.array("p_brand", F.upper("p_brand"), F.upper("p_type")).alias("labels"))
    stored = p.where("p_size > 45").groupBy(F.lower("p_type").alias("key")).agg(F.upper(F.min("p_type")).alias("name"), F.array(F.min("p_name")).alias("labels"))
    return audit.dictionary(entries, stored).select("key", "name", F.array_join("labels", "|").alias("labels"), "is_new")


def _concepts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") * 10000 + F.col("turn")
    return c.select(k.alias("id"), F.when(F.col("role") == "user", "decision").when(F.col("role") == "system", "noise").when(k % 3 > 0, "constraint").alias("kind"), "text", (k % 11 / 10.0).alias("confidence"), k.alias("message"), F.col("conv_id").alias("session"))


def concept_reified(spark, sf_dir):
    made = audit.reify(_concepts(spark, sf_dir))[0]
    return made.groupBy("kind", "confidence_low").agg(F.count("*").alias("n"), F.countDistinct("artifact_id").alias("ids"), F.round(F.sum("confidence"), 4).alias("confidence"))


def concept_reified_edges(spark, sf_dir):
    links = audit.reify(_concepts(spark, sf_dir))[1]
    return links.groupBy("rel_type").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


def concept_schema_type(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    gist = F.element_at(F.array(*[F.lit(g) for g in _GISTS]), (k % len(_GISTS) + 1).cast("int"))
    label = F.when(k % 3 == 0, "PERSON").when(k % 3 == 1, "ORG")
    return e.select("event_id", audit.schema_type(gist, label).alias("t")).groupBy("t.schema_type").agg(F.count("*").alias("n"), F.max(F.array_join("t.properties", " ")).alias("properties"))


_GISTS = ["Restriction", "PlannedEvent", "PhysicalThing", "Magnitude", "Category", "Agent", "Event", "Idea"]


def session_warm_nodes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return audit.warm(e.select(F.when(F.col("event_type") == "signup", "unknown").otherwise(F.col("user_id").cast("string")).alias("session"), F.when(F.col("event_id") % 13 > 0, F.col("event_id") % 40).alias("node"), F.col("value").alias("activation")))


QUERIES = {f.__name__: f for f in (audit_lesson_flags, audit_polarity, audit_plan_valence, plan_retrospective, graph_temporal_context, concept_dictionary, concept_reified, concept_reified_edges, concept_schema_type, session_warm_nodes)}

_KIND = "CASE o_orderkey % 4 WHEN 0 THEN 'APPLIES_TO' WHEN 1 THEN 'CONTAINS_LESSON' WHEN 2 THEN 'LEARNED' ELSE 'SEEN' END"
_MADE = """made AS (SELECT * FROM (SELECT conv_id * 10000 + turn AS id, conv_id, CASE WHEN role = 'user' THEN 'decision' WHEN role = 'system' THEN NULL WHEN (conv_id * 10000 + turn) % 3 > 0 THEN 'constraint' END AS kind,
  (conv_id * 10000 + turn) % 11 / 10.0 AS confidence FROM conversations) WHERE confidence >= 0.6 AND kind IS NOT NULL)"""

ORACLE_SQL = {
    "audit_lesson_flags": f"""WITH o AS (SELECT o_custkey, {_KIND} AS kind FROM orders WHERE o_totalprice > 300000), f AS (SELECT c_custkey AS id,
  coalesce(c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_acctbal < 4000, false) AND c_custkey NOT IN (SELECT o_custkey FROM o WHERE kind = 'APPLIES_TO') AS stale, c_custkey NOT IN (SELECT o_custkey FROM o WHERE kind IN ('CONTAINS_LESSON', 'LEARNED')) AS orphan
  FROM customer WHERE c_nationkey <> 3) SELECT * FROM f WHERE stale OR orphan""",
    "audit_polarity": f"""WITH {SPOKEN_SQL}, v AS (SELECT message_id AS id, CASE WHEN (session_id + turn) % 2 = 0 THEN 'success' ELSE 'failure' END AS old, CAST({_VALENCE} AS DOUBLE) AS new_valence, text FROM spoken
  WHERE (session_id + turn) % 5 <> 0 AND (session_id + turn) % 9 <> 0 AND NOT ((session_id + turn) % 2 = 1 AND (session_id + turn) % 7 = 1)), w AS (SELECT *, CASE WHEN new_valence > 0 THEN 'success' WHEN new_valence < 0 THEN 'failure' END AS new FROM v)
  SELECT id, CASE WHEN new IS NULL THEN 'archive' ELSE 'flip' END AS action, old, sha256('Plan outcome (' || new || '): ' || text || chr(10) || '[valence_relabel: was ' || old || ']') AS text_sha256, new_valence FROM w WHERE new IS NULL OR new <> old""",
    "audit_plan_valence": f"""WITH {SPOKEN_SQL}, b AS (SELECT session_id AS id, 'goal ' || session_id || chr(10) || string_agg(text, chr(10) ORDER BY turn) AS text FROM spoken GROUP BY session_id),
  j AS (SELECT id, CASE id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN -0.5 END::DOUBLE AS valence, CAST({_VALENCE} AS DOUBLE) AS new_valence FROM b WHERE id % 4 <> 0 AND id % 11 <> 0) SELECT * FROM j WHERE sign(valence) <> sign(new_valence)""",
    "plan_retrospective": f"""WITH {SPOKEN_SQL}, {NODES_SQL}, n AS (SELECT session_id AS session, turn, trim(text) AS t, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY session_id) AS found FROM spoken WHERE trim(text) <> ''),
  g AS (SELECT session, max(CASE WHEN n = 1 THEN t END) AS goal, string_agg(t, '|' ORDER BY n) AS steps FROM n WHERE n <= 5 AND found >= 3 GROUP BY session)
  SELECT session, sha256(substr(goal, 1, 240)) AS goal_sha256, sha256(steps) AS steps_sha256 FROM g JOIN nodes s ON s.node_id = g.session
  WHERE NOT EXISTS (SELECT 1 FROM nodes p WHERE p.archived AND p.label = s.label AND list_cosine_similarity(s.v, p.v) > 0.9)""",
    "graph_temporal_context": """WITH t AS (SELECT event_id AS id, substr(props, 1, 200) AS text FROM events WHERE event_type <> 'error' AND coalesce(props, '') <> ''),
  e AS (SELECT o_custkey AS a, o_orderkey AS b FROM orders WHERE o_orderstatus IN ('F', 'O')), n AS (SELECT a AS id, b AS near FROM e UNION SELECT b, a FROM e),
  r AS (SELECT n.id, near, text, row_number() OVER (PARTITION BY n.id ORDER BY near) AS k FROM n JOIN t ON t.id = n.near)
  SELECT id, sha256(string_agg(text, '|' ORDER BY k)) AS context_sha256, count(*) AS n FROM r WHERE k <= 3 GROUP BY id""",
    "concept_dictionary": """WITH stored AS (SELECT lower(p_type) AS key, upper(min(p_type)) AS name, min(p_name) AS label FROM part WHERE p_size > 45 GROUP BY 1),
  l AS (SELECT key, lower(trim(label)) AS low, min(trim(label)) AS label FROM (SELECT lower(trim(p_type)) AS key, unnest([p_brand, upper(p_brand), upper(p_type)]) AS label FROM part UNION ALL SELECT key, label FROM stored) WHERE lower(trim(label)) <> key AND trim(label) <> '' GROUP BY 1, 2)
  SELECT k.key, coalesce(s.name, k.name) AS name, coalesce((SELECT string_agg(label, '|' ORDER BY label) FROM l WHERE l.key = k.key), '') AS labels, s.key IS NULL AS is_new
  FROM (SELECT lower(trim(p_type)) AS key, min(trim(p_type)) AS name FROM part GROUP BY 1) k LEFT JOIN stored s USING (key)""",
    "concept_reified": f"WITH {_MADE} SELECT kind, confidence < 0.9 AS confidence_low, count(*) AS n, count(DISTINCT id) AS ids, round(sum(confidence), 4)::DOUBLE AS confidence FROM made GROUP BY ALL",
    "concept_reified_edges": f"""WITH {_MADE} SELECT 'REIFIED_AS' AS rel_type, count(*) AS n, count(DISTINCT id) AS sources, count(DISTINCT id) AS targets FROM made
  UNION ALL SELECT 'ESTABLISHED', count(*), count(DISTINCT id), count(DISTINCT id) FROM made UNION ALL SELECT 'ESTABLISHED_IN', count(*), count(DISTINCT id), count(DISTINCT conv_id) FROM made""",
    "concept_schema_type": "SELECT x.t AS schema_type, count(*) AS n, max(x.p) AS properties FROM (SELECT unnest(CASE event_id % 8 "
    + " ".join(
        f"WHEN {i} THEN " + (f"[CASE event_id % 3 WHEN 0 THEN {{'t': '{audit.ROUTES['Agent:PERSON'][0]}', 'p': '{' '.join(audit.ROUTES['Agent:PERSON'][1])}'}} WHEN 1 THEN {{'t': '{audit.ROUTES['Agent:ORG'][0]}', 'p': '{' '.join(audit.ROUTES['Agent:ORG'][1])}'}} ELSE {{'t': 'Thing', 'p': 'name description'}} END]" if g == "Agent" else "[{'t': '%s', 'p': '%s'}]" % (audit.ROUTES.get(g, audit.ROUTES[""])[0], " ".join(audit.ROUTES.get(g, audit.ROUTES[""])[1])))
        for i, g in enumerate(_GISTS)
    )
    + " END) AS x FROM events) GROUP BY x.t",
    "session_warm_nodes": "SELECT CAST(user_id AS VARCHAR) AS session, event_id % 40 AS node, max(coalesce(value, 0)) AS activation FROM events WHERE event_type <> 'signup' AND event_id % 13 > 0 GROUP BY ALL",
}
