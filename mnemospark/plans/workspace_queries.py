"""Queries of concepts, provenance, views and text rules of a workspace, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import workspace
from mnemospark.sources.memory_tables import EDGES_SQL, NODES_SQL, edges, nodes, table


def _stored(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_type").alias("text"), (k % 9 / 8.0).alias("strength"), (k % 7 / 6.0).alias("salience"), (k % 4 > 0).alias("confidence_low"), (k % 6 == 0).alias("archived"))


def concept_store(spark, sf_dir):
    """Types of parts as concepts; segments and types in capitals come in."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.when(k % 5 == 0, F.concat(F.lit("new "), "p_brand")).otherwise(F.upper("p_type")).alias("text"), (k % 11 / 10.0).alias("confidence"), (1 + k % 3 / 4.0).alias("salience"))
    return workspace.store_concepts(_stored(spark, sf_dir).where("NOT archived AND id % 3 = 0"), p)


def _merges(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    concepts = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 10 / 10.0).alias("strength"), (F.col("o_orderstatus") == "P").alias("archived"))
    pairs = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("old_id"), F.col("o_orderkey") + 1, F.col("o_orderdate").alias("at")).toDF("old_id", "new_id", "at")
    return concepts, workspace.contradictions(pairs, concepts)


def concept_merge_events(spark, sf_dir):
    """The newest fifty merges."""
    return _merges(spark, sf_dir)[1].orderBy(F.desc("at"), "old_id").limit(50).select("old_id", "new_id", "pre_strength")


def concept_rollback(spark, sf_dir):
    concepts, events = _merges(spark, sf_dir)
    return workspace.apply_merges(concepts, events, events.where("old_id % 2 = 0").select("old_id"))


def concept_review(spark, sf_dir):
    n = nodes(spark, sf_dir).select(F.col("node_id").alias("id"), "confidence", (F.col("confidence") < 0.6).alias("confidence_low"), "archived")
    return workspace.reviewed(n, n.where("id % 4 > 1").select("id", (F.col("id") % 4 == 2).alias("confirmed")))


def concept_open_loops(spark, sf_dir):
    """Live nodes that nobody is sure of, newest first, fifty."""
    n = nodes(spark, sf_dir).where("NOT archived AND confidence < 0.6")
    return n.orderBy(F.desc("node_id")).limit(50).select("node_id", "confidence")


def concept_relations(spark, sf_dir):
    n = _stored(spark, sf_dir)
    line = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    one, two = line.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("pa"), "l_returnflag"), line.where("l_linenumber = 2").select("l_orderkey", F.col("l_partkey").alias("pb"))
    j = one.join(two, "l_orderkey").join(p.select(F.col("p_partkey").alias("pa"), F.upper("p_type").alias("a")), "pa").join(p.select(F.col("p_partkey").alias("pb"), F.col("p_type").alias("b")), "pb")
    return workspace.store_relations(j.select("a", "b", F.col("l_returnflag").alias("rel_type")), n, ("A", "R"))


def lesson_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stored = e.where("event_id % 5 = 0").groupBy(F.col("user_id").alias("id")).agg(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), (F.count("*") % 10 / 10.0).alias("strength")).select("id", "key", "strength")
    incoming = e.where("event_id % 3 = 0").select(F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("id"), F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"))
    return workspace.upsert_lessons(stored, incoming)


def lesson_outcomes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("plan"), F.round(F.col("value") / 40 - 1, 6).alias("valence"))
    return workspace.outcome_lessons(e)


def agent_workers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.when(F.col("user_id") % 3 == 0, "user:").otherwise("agent:"), F.col("user_id").cast("string")).alias("source"), (F.col("event_id") % 12).alias("node"), F.col("event_id").alias("at"))
    return workspace.workers(e)


def _projected(spark, sf_dir):
    c = F.col("c_custkey")
    kind = F.when(c % 4 == 0, "projected").when(c % 4 == 1, "earned").when(c % 4 == 2, "imported")
    return table(spark, sf_dir, "customer").select(c.alias("id"), kind.alias("authority"), F.col("c_mktsegment").alias("source"), F.when(c % 8 < 6, F.concat(F.lit("v"), (c % 3).cast("string"))).alias("source_version"))


def provenance_stale(spark, sf_dir):
    return workspace.stale_projections(_projected(spark, sf_dir), "BUILDING", "v1").select("id", "source_version")


def provenance_drop(spark, sf_dir):
    return workspace.drop_projections(_projected(spark, sf_dir), "source")


def provenance_rejected(spark, sf_dir):
    """Projected rows must name a source and a version; how many do not, by authority."""
    p = _projected(spark, sf_dir)
    bad = (workspace.authority(F.col("authority")) == "projected") & (F.col("source").isNull() | F.col("source_version").isNull())
    return p.groupBy(workspace.authority(F.col("authority")).alias("authority")).agg(F.count("*").alias("n"), F.count_if(bad).alias("rejected"))


def view_graph(spark, sf_dir):
    n = nodes(spark, sf_dir).select(F.col("node_id").alias("id"), F.col("label").cast("string").alias("label"), "strength", "archived")
    return workspace.per_label_top(n, {"0": 30, "1": 20, "2": 20, "3": 10})


def view_node_neighbours(spark, sf_dir):
    e = edges(spark, sf_dir)
    wanted = e.select(F.col("dst").alias("node")).where("node LIKE 'c%'").distinct()
    return workspace.neighbours(e.where("rel_type <> 'REQUIRES'").select("src", "dst", "rel_type"), wanted, 5)


def view_card_hop(spark, sf_dir):
    e = edges(spark, sf_dir).select("src", "dst", "rel_type")
    frontier = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    return workspace.hop(e, frontier, 25)


def view_ledger(spark, sf_dir):
    """Live constraints of two tables by strength, a hundred."""
    n = nodes(spark, sf_dir).where("NOT archived")
    a = n.where("label = 1").select(F.lit("Constraint").alias("kind"), F.col("node_id").alias("id"), "strength")
    b = n.where("label = 2").select(F.lit("GlobalConstraint").alias("kind"), F.col("node_id").alias("id"), "strength")
    return a.unionByName(b).orderBy(F.desc("strength"), "kind", "id").limit(100)


def view_continuity(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy((F.col("user_id") % 20).alias("app"), F.col("user_id").alias("session_id")).agg(F.min("ts").alias("started_at"))
    found = workspace.continuity(s, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return found.select("app", "session_id", "rank", workspace.relative_time(F.col("started_at"), F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("when"))


def view_disambiguation(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    s = table(spark, sf_dir, "supplier").where("s_suppkey > 1").select(F.col("s_suppkey").alias("a"), F.floor(F.col("s_suppkey") / 2).alias("b"), F.col("s_suppkey").alias("at"))
    return workspace.disambiguation(s, line)


def view_policies(spark, sf_dir):
    """Distinct policies (segment and nation) of each region's customers; a region without customers keeps none."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer").where("c_acctbal > 9000")
    j = n.join(c, n["n_nationkey"] == c["c_nationkey"], "left")
    policy = F.when(F.col("c_mktsegment").isNotNull(), F.struct("c_mktsegment", "n_name"))
    return j.groupBy("n_regionkey").agg(F.size(F.collect_set(policy)).cast("long").alias("policies"))


def view_recent(spark, sf_dir):
    """The last three events of each user, in order."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    return last.groupBy("user_id").agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("rn", "event_id")))), lambda x: x["event_id"].cast("string")), ",").alias("events"))


def fact_chain_end(spark, sf_dir):
    """Orders superseded by the customer's next order: where each chain ends."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst")).where("dst IS NOT NULL")
    return workspace.chain_end(e)


def text_plan_steps(spark, sf_dir):
    """The words of a turn, a numbered line each, with a repeat and a crumb."""
    c = table(spark, sf_dir, "conversations")
    words = F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 6)
    text = F.concat(F.array_join(F.transform(words, lambda w, i: F.concat((i + 1).cast("string"), F.lit(". "), w)), "\n"), F.lit("\nthen: rest\n- next go\n- plain\n7) no\nStep 8: rest"))
    return c.select("conv_id", "turn", F.array_join(workspace.plan_steps(text), "|").alias("steps"))


def text_entity_sentence(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    entity = F.element_at(F.split(F.trim("text"), " "), F.lit(-1))
    return d.select("doc_id", F.sha2(workspace.sentence_of(F.col("text"), entity), 256).alias("sentence_sha256"))


def text_redacted(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.element_at(F.array(F.lit("Api_Key"), F.lit("body_html"), F.lit("url"), F.lit("cookie_jar")), (F.col("page_id") % 4 + 1).cast("int")).alias("key"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return p.select("page_id", workspace.redacted(F.col("key"), F.when(F.col("key") == "body_html", F.col("html")).otherwise(F.col("url"))).alias("shown"))


def text_signal_floor(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.substring("p_type", 1, 4)).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).alias("t"))
    return p.select("p_partkey", workspace.signal_floor(F.col("t")).alias("passes"))


def text_quest_ids(spark, sf_dir):
    """Stable ids of repositories: the head of a hash; the branch says nothing."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.substring(F.sha2(F.trim("s_name"), 256), 1, 32).alias("quest_id"))


def text_records(spark, sf_dir):
    """The nations of each region as a compact record table: header and rows."""
    n = table(spark, sf_dir, "nation")
    row = F.struct("n_nationkey", F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name").alias("line"))
    return n.groupBy("n_regionkey").agg(F.concat(F.lit("{n_nationkey,n_name}:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["line"]), "\n")).alias("records"))


QUERIES = {
    f.__name__: f
    for f in (
        concept_store, concept_merge_events, concept_rollback, concept_review, concept_open_loops, concept_relations, lesson_upsert, lesson_outcomes, agent_workers, provenance_stale, provenance_drop, provenance_rejected,
        view_graph, view_node_neighbours, view_card_hop, view_ledger, view_continuity, view_disambiguation, view_policies, view_recent, fact_chain_end, text_plan_steps, text_entity_sentence, text_redacted,
        text_signal_floor, text_quest_ids, text_records,
    )
}

_CONCEPTS = "c AS (SELECT p_partkey AS id, p_type AS text, p_partkey % 9 / 8 AS strength, p_partkey % 7 / 6 AS salience, p_partkey % 4 > 0 AS low, p_partkey % 6 = 0 AS archived FROM part)"
_MERGES = """c AS (SELECT o_orderkey AS id, o_orderkey % 10 / 10 AS strength, o_orderstatus = 'P' AS archived, o_orderdate AS made FROM orders), m AS (SELECT id AS old_id, id + 1 AS new_id, made, strength AS pre_strength FROM c WHERE id % 3 = 0 AND NOT archived)"""
_PROJECTED = """p AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'projected' ELSE 'earned' END AS authority, c_mktsegment AS source, CASE WHEN c_custkey % 8 < 6 THEN 'v' || (c_custkey % 3) END AS source_version FROM customer)"""

ORACLE_SQL = {
    "concept_store": f"""WITH {_CONCEPTS}, o AS (SELECT lower(text) AS key, max(strength) AS s, max(salience) AS sal, bool_and(low) AS low FROM c WHERE NOT archived AND id % 3 = 0 GROUP BY 1
), i AS (SELECT lower(CASE WHEN p_partkey % 5 = 0 THEN 'new ' || p_brand ELSE p_type END) AS key, p_partkey % 11 / 10 AS conf, 1 + p_partkey % 3 / 4 AS sal FROM part
), n AS (SELECT key, max(conf * sal) AS made, max(sal) AS sal, max(conf) AS conf FROM i GROUP BY key)
SELECT key, CASE WHEN o.s IS NULL THEN 'created' ELSE 'reinforced' END AS action, round(greatest(made, coalesce(o.s, 0.5)), 6)::DOUBLE AS strength, round(greatest(n.sal, coalesce(o.sal, n.sal)), 6)::DOUBLE AS salience, coalesce(o.low, true) AND conf < 0.8 AS confidence_low FROM n LEFT JOIN o USING (key)""",
    "concept_merge_events": f"WITH {_MERGES} SELECT old_id, new_id, pre_strength FROM m ORDER BY made DESC, old_id LIMIT 50",
    "concept_rollback": f"""WITH {_MERGES} SELECT id, strength, CASE WHEN id IN (SELECT old_id FROM m WHERE old_id % 2 = 0) THEN false ELSE archived OR id IN (SELECT old_id FROM m WHERE old_id % 2 = 1) OR id IN (SELECT new_id FROM m WHERE old_id % 2 = 0) END AS archived,
  CASE WHEN id % 2 = 1 THEN (SELECT any_value(new_id) FROM m WHERE old_id = id) END AS deprecated_by FROM c""",
    "concept_review": f"""WITH {NODES_SQL} SELECT node_id AS id, (CASE WHEN node_id % 4 = 2 THEN 0.95 ELSE confidence END)::DOUBLE AS confidence, confidence < 0.6 AND node_id % 4 <> 2 AS confidence_low, archived OR node_id % 4 = 3 AS archived FROM nodes""",
    "concept_open_loops": f"WITH {NODES_SQL} SELECT node_id, confidence FROM nodes WHERE NOT archived AND confidence < 0.6 ORDER BY node_id DESC LIMIT 50",
    "concept_relations": f"""WITH {_CONCEPTS}, e AS (SELECT * FROM (SELECT lower(text) AS t, id, row_number() OVER (PARTITION BY lower(text) ORDER BY strength DESC, id) AS rn FROM c WHERE NOT archived) WHERE rn = 1
), r AS (SELECT lower(pa.p_type) AS a, lower(pb.p_type) AS b, x.l_returnflag AS rel_type FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = 1 AND y.l_linenumber = 2 JOIN part pa ON pa.p_partkey = x.l_partkey JOIN part pb ON pb.p_partkey = y.l_partkey)
SELECT s.id AS src, d.id AS dst, rel_type, count(*) AS n FROM r JOIN e s ON s.t = a JOIN e d ON d.t = b WHERE rel_type IN ('A', 'R') AND s.id <> d.id GROUP BY ALL""",
    "lesson_upsert": """WITH s AS (SELECT user_id, count(*) % 10 / 10 AS strength FROM events WHERE event_id % 5 = 0 GROUP BY user_id), i AS (SELECT DISTINCT user_id FROM events WHERE event_id % 3 = 0)
SELECT 'k' || user_id AS key, 'updated' AS action, round(least(1.0, strength + 0.1), 6)::DOUBLE AS strength FROM i JOIN s USING (user_id) WHERE user_id % 2 = 0
UNION ALL SELECT 'k' || user_id, CASE WHEN strength IS NULL THEN 'created' ELSE 'unchanged' END, round(coalesce(strength, 0.5), 6)::DOUBLE FROM i LEFT JOIN s USING (user_id) WHERE user_id % 2 = 1""",
    "lesson_outcomes": "SELECT event_id AS plan, CASE WHEN v > 0 THEN 'success' ELSE 'failure' END AS kind, abs(v) AS strength FROM (SELECT event_id, round(value / 40 - 1, 6) AS v FROM events) WHERE abs(v) > 0.7",
    "agent_workers": "SELECT CAST(user_id AS VARCHAR) AS worker, min(event_id) AS first_seen, max(event_id) AS last_seen, count(DISTINCT event_id % 12) AS solved FROM events WHERE user_id % 3 <> 0 GROUP BY user_id",
    "provenance_stale": f"WITH {_PROJECTED} SELECT id, source_version FROM p WHERE authority = 'projected' AND source = 'BUILDING' AND source_version <> 'v1'",
    "provenance_drop": f"WITH {_PROJECTED} SELECT source, count(*) FILTER (authority = 'projected') AS deleted, count(*) FILTER (authority <> 'projected') AS skipped_earned FROM p GROUP BY source",
    "provenance_rejected": f"WITH {_PROJECTED} SELECT authority, count(*) AS n, count(*) FILTER (authority = 'projected' AND (source IS NULL OR source_version IS NULL)) AS rejected FROM p GROUP BY authority",
    "view_graph": f"""WITH {NODES_SQL}, r AS (SELECT CAST(label AS VARCHAR) AS label, node_id AS id, CAST(row_number() OVER (PARTITION BY label ORDER BY strength DESC, node_id) AS INTEGER) AS rank FROM nodes WHERE NOT archived)
SELECT * FROM r WHERE rank <= CASE label WHEN '0' THEN 30 WHEN '1' THEN 20 WHEN '2' THEN 20 WHEN '3' THEN 10 ELSE 0 END""",
    "view_node_neighbours": """WITH b AS (SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS other, 'CONTAINS' AS rel_type FROM customer UNION SELECT 'c' || o_custkey, 'o' || o_orderkey, 'INVOKES' FROM orders
), w AS (SELECT b.*, CAST(row_number() OVER (PARTITION BY node ORDER BY other, rel_type) AS INTEGER) AS rank FROM b WHERE node IN (SELECT 'c' || c_custkey FROM customer)) SELECT * FROM w WHERE rank <= 5""",
    "view_card_hop": f"""WITH {EDGES_SQL}, f AS (SELECT 'n' || n_nationkey AS node FROM nation), b AS (SELECT DISTINCT src AS node, dst AS other, rel_type, 'out' AS direction FROM edges WHERE src IN (SELECT node FROM f) UNION SELECT dst, src, rel_type, 'in' FROM edges WHERE dst IN (SELECT node FROM f)
), r AS (SELECT *, row_number() OVER (PARTITION BY node, rel_type, direction ORDER BY other) AS rn FROM b) SELECT node, other, rel_type, direction FROM r WHERE rn <= 25""",
    "view_ledger": f"""WITH {NODES_SQL} SELECT CASE label WHEN 1 THEN 'Constraint' ELSE 'GlobalConstraint' END AS kind, node_id AS id, strength FROM nodes WHERE NOT archived AND label IN (1, 2) ORDER BY strength DESC, kind, id LIMIT 100""",
    "view_continuity": """WITH s AS (SELECT user_id % 20 AS app, user_id AS session_id, min(ts) AS t FROM events GROUP BY user_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY app ORDER BY t DESC, session_id) AS INTEGER) AS rank FROM s WHERE t >= TIMESTAMP '2024-01-01'
), d AS (SELECT *, CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(t)) / 86400000000) AS BIGINT) AS days FROM r WHERE rank <= 5)
SELECT app, session_id, rank, CASE WHEN days <= 0 THEN 'today' WHEN days = 1 THEN '1 day ago' ELSE days || ' days ago' END AS "when" FROM d""",
    "view_disambiguation": """WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), g AS (SELECT s_suppkey AS a, s_suppkey // 2 AS b FROM supplier WHERE s_suppkey > 1 ORDER BY s_suppkey DESC LIMIT 50
), x AS (SELECT a, b, string_agg(CAST(e.p AS VARCHAR), ',' ORDER BY e.p) AS shared FROM g JOIN e ON e.s = a JOIN e f ON f.s = b AND f.p = e.p GROUP BY a, b) SELECT a, b, coalesce(shared, '') AS shared FROM g LEFT JOIN x USING (a, b)""",
    "view_policies": """SELECT n_regionkey, count(DISTINCT CASE WHEN c_mktsegment IS NOT NULL THEN c_mktsegment || '|' || n_name END) AS policies FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) ON c_nationkey = n_nationkey GROUP BY n_regionkey""",
    "view_recent": """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn DESC) AS events FROM r WHERE rn <= 3 GROUP BY user_id""",
    "fact_chain_end": """WITH w AS (SELECT o_orderkey AS id, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) - 1 AS hops FROM orders) SELECT * FROM w WHERE hops > 0""",
    "text_plan_steps": r"""WITH l AS (SELECT conv_id, turn, string_split(array_to_string(list_transform(string_split(coalesce(text, ''), ' ')[1:6], lambda w, i: i || '. ' || w), chr(10)) || chr(10) || 'then: rest' || chr(10) || '- next go' || chr(10) || '- plain' || chr(10) || '7) no' || chr(10) || 'Step 8: rest', chr(10)) AS raw FROM conversations
), t AS (SELECT conv_id, turn, list_filter(list_transform(raw, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM l
), f AS (SELECT conv_id, turn, list_transform(ls, lambda x: CASE WHEN regexp_matches(x, '^(?:step\s+)?\d+[.):]\s+(.+)$', 'i') THEN trim(regexp_extract(x, '^(?:step\s+)?\d+[.):]\s+(.+)$', 1, 'i'))
  WHEN regexp_matches(x, '^(?:first|then|next|finally)\b[:\-]?\s*(.+)$', 'i') THEN trim(regexp_extract(x, '^(?:first|then|next|finally)\b[:\-]?\s*(.+)$', 1, 'i'))
  WHEN regexp_matches(regexp_extract(x, '^[\-•]\s+(.+)$', 1), '^(?:first|then|next|finally)\b[:\-]?\s*(.+)$', 'i') THEN trim(regexp_extract(x, '^[\-•]\s+(.+)$', 1)) END) AS s FROM t
), g AS (SELECT conv_id, turn, list_filter(s, lambda x: x IS NOT NULL AND length(x) >= 3) AS s FROM f)
SELECT conv_id, turn, coalesce(array_to_string(list_filter(s, lambda x, i: list_position(list_transform(s, lambda y: lower(y)), lower(x)) = i), '|'), '') AS steps FROM g""",
    "text_entity_sentence": r"""WITH e AS (SELECT doc_id, text, string_split(trim(text), ' ')[-1] AS ent FROM documents), p AS (SELECT *, instr(lower(text), lower(ent)) AS pos FROM e
), b AS (SELECT *, substr(text, 1, pos - 1) AS before, substr(text, pos) AS rest FROM p
), s AS (SELECT *, trim(string_split(before, '.')[-1] || CASE WHEN instr(rest, '.') > 0 THEN substr(rest, 1, instr(rest, '.')) ELSE rest END) AS found FROM b)
SELECT doc_id, sha256(CASE WHEN pos = 0 OR found = '' THEN text ELSE found END) AS sentence_sha256 FROM s""",
    "text_redacted": """SELECT page_id, CASE WHEN page_id % 4 IN (0, 3) THEN CASE WHEN coalesce(url, '') = '' THEN '' ELSE substr(sha256(url), 1, 8) || ':[redacted]' END
  WHEN page_id % 4 = 1 THEN CASE WHEN length(coalesce(html, '')) > 100 THEN '[' || length(html) || ' chars]' ELSE substr(coalesce(html, ''), 1, 300) END ELSE substr(coalesce(url, ''), 1, 300) END AS shown FROM pages""",
    "text_signal_floor": """WITH t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN substr(p_type, 1, 4) WHEN 1 THEN p_name END AS t FROM part)
SELECT p_partkey, coalesce(t = '' OR contains(trim(t), ' ') OR length(trim(t)) >= 6, true) AS passes FROM t""",
    "text_quest_ids": "SELECT s_suppkey, substr(sha256(trim(s_name)), 1, 32) AS quest_id FROM supplier",
    "text_records": "SELECT n_regionkey, '{n_nationkey,n_name}:' || chr(10) || string_agg(n_nationkey || ',' || n_name, chr(10) ORDER BY n_nationkey) AS records FROM nation GROUP BY n_regionkey",
}
