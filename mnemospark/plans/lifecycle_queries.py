"""Queries of maintenance and pattern mining, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import lifecycle, patterns
from mnemospark.sources.memory_tables import NODES_SQL, nodes, table


def _r(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


def life_decay_archive(spark, sf_dir):
    n = nodes(spark, sf_dir).withColumn("strength", F.col("strength") / 5)
    out = lifecycle.decay_and_archive(n, F.when(F.col("node_id") % 3 == 0, 0.95).otherwise(0.99), 30.0)
    return _r(out.select("node_id", "strength", "archived"), "strength")


def life_hebbian(spark, sf_dir):
    return nodes(spark, sf_dir).select("node_id", F.round(lifecycle.hebbian(F.col("strength"), (F.col("node_id") % 40).cast("double")), 6).alias("strength"))


def life_valence_decay(spark, sf_dir):
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("node_id"), (F.col("quality") - F.col("toxic")).alias("valence"))
    n = nodes(spark, sf_dir).withColumn("strength", F.col("strength") / 5)
    return _r(lifecycle.valence_decay(n, outcomes).select("node_id", "strength"), "strength")


def _procedures(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    g = e.groupBy("user_id", "event_type").agg(F.count("*").alias("uses"), F.avg((F.col("value") > 20).cast("int")).alias("success_rate"))
    return g.withColumn("strength", (F.col("user_id") % 10) / 10.0)


def life_maturity(spark, sf_dir):
    return _r(lifecycle.maturity(_procedures(spark, sf_dir)).select("user_id", "event_type", "stage", "strength", "archived"), "strength")


def life_maturity_alternate(spark, sf_dir):
    return lifecycle.maturity_alternate(_procedures(spark, sf_dir)).select("user_id", "event_type", "stage")


def life_resurrect(spark, sf_dir):
    return lifecycle.resurrect(nodes(spark, sf_dir), 0.3).select("node_id", "strength", "archived")


def life_index_hygiene(spark, sf_dir):
    return _r(lifecycle.hygiene(nodes(spark, sf_dir), "label", 0.1), "ratio")


def life_knowledge_gaps(spark, sf_dir):
    lessons = table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 45).alias("domain")).agg(F.count("*").alias("lessons"), F.avg("quality").alias("confidence"))
    said = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy((F.col("user_id") % 60).alias("domain")).agg(F.count("*").alias("messages"))
    plans = table(spark, sf_dir, "conversations").groupBy((F.col("conv_id") % 50).alias("domain")).agg(F.count("*").alias("plans"))
    return _r(lifecycle.knowledge_gaps(lessons, said, plans), "severity")


def life_prune_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    sessions = e.groupBy("session_id").agg(F.min("ts").alias("started_at"), F.max(F.when(F.col("session_id") % 4 > 0, F.col("ts"))).alias("last_active_at"))
    now = F.lit("2024-02-10 00:00:00").cast("timestamp")
    return lifecycle.prune_sessions(e, sessions, now, 13).select("session_id", "event_id")


def life_procedure_synthesis(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    plans = e.select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("strategy"), (F.col("value") / 40).alias("valence"), ((F.col("event_id") % 100) / 100.0).alias("strength"), ((F.col("event_id") % 7) / 7.0).alias("confidence"))
    return _r(lifecycle.synthesise(plans), "strength", "confidence")


def life_rescore(spark, sf_dir):
    n = nodes(spark, sf_dir)
    links = n.where("node_id > 0").select(F.col("node_id").alias("src"), F.floor(F.col("node_id") / 2).alias("dst"))
    return _r(lifecycle.rescore(n, links).select("node_id", "n", "new_confidence", "promoted"), "new_confidence")


def life_leader_clusters(spark, sf_dir):
    """Rows only: greedy, so held against a brute-force version in the tests."""
    return lifecycle.leaders(nodes(spark, sf_dir), 0.25, 2, 4)


def _series(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))


def pattern_temporal(spark, sf_dir):
    out = patterns.regular(_series(spark, sf_dir), 0.60)
    return out.select("key", "n", F.round("mean_gap", 3).alias("mean_gap"), F.round("cv", 5).alias("cv"))


def pattern_frequency(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    counts = e.groupBy(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.to_date("ts").alias("started_at")).agg(F.count("*").alias("n_messages"))
    return _r(patterns.rising(counts), "slope", "mean")


def pattern_sequence(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("plan"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("kind"), (F.col("event_type") == "error").alias("failed"))
    return patterns.before_failures(e, 3)


def pattern_dedupe(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    candidates = e.select(F.when(F.col("user_id") % 9 == 0, " ").otherwise(F.concat("event_type", (F.col("user_id") % 5).cast("string"))).alias("trigger")).distinct()
    known = e.where("value > 60").select(F.concat("event_type", (F.col("user_id") % 3).cast("string")).alias("trigger"))
    return patterns.unregistered(candidates, known)


QUERIES = {f.__name__: f for f in (life_decay_archive, life_hebbian, life_valence_decay, life_maturity, life_maturity_alternate, life_resurrect, life_index_hygiene, life_knowledge_gaps, life_prune_sessions, life_procedure_synthesis, life_rescore, life_leader_clusters, pattern_temporal, pattern_frequency, pattern_sequence, pattern_dedupe)}

_PROC = """WITH p AS (SELECT user_id, event_type, count(*) AS uses, avg(CAST(value > 20 AS INTEGER)) AS ok, (user_id % 10) / 10.0 AS s FROM events GROUP BY user_id, event_type)"""

ORACLE_SQL = {
    "life_decay_archive": f"""WITH {NODES_SQL}, d AS (SELECT node_id, strength / 5 * pow(CASE WHEN node_id % 3 = 0 THEN 0.95 ELSE 0.99 END, 30) AS s, archived FROM nodes)
SELECT node_id, round(s, 6)::DOUBLE AS strength, archived OR s < 0.1 AS archived FROM d""",
    "life_hebbian": f"WITH {NODES_SQL} SELECT node_id, round(strength + ln(1 + 1 / greatest(node_id % 40, 1.0::DOUBLE / 86400)), 6)::DOUBLE AS strength FROM nodes",
    "life_valence_decay": f"""WITH {NODES_SQL}, v AS (SELECT doc_id, avg(quality - toxic) AS m FROM labels GROUP BY doc_id)
SELECT node_id, round(least(1.0, greatest(0.0, strength / 5 * (1 + 0.3 * m))), 6)::DOUBLE AS strength FROM nodes JOIN v ON node_id = doc_id""",
    "life_maturity": _PROC + """, t AS (SELECT *, CASE WHEN uses >= 5 AND ok >= 0.75 THEN 'mature' WHEN uses >= 3 AND ok >= 0.5 THEN 'developing' WHEN uses >= 3 AND ok < 0.3 THEN 'degraded' ELSE 'new' END AS stage FROM p
), h AS (SELECT *, CASE WHEN stage = 'degraded' THEN s * 0.5 ELSE s END AS s2 FROM t) SELECT user_id, event_type, stage, round(s2, 6)::DOUBLE AS strength, stage = 'degraded' AND s2 < 0.2 AS archived FROM h""",
    "life_maturity_alternate": _PROC + " SELECT user_id, event_type, CASE WHEN uses >= 3 AND ok < 0.4 THEN 'degraded' WHEN uses >= 10 THEN 'mature' WHEN uses >= 3 THEN 'developing' ELSE 'new' END AS stage FROM p",
    "life_resurrect": f"""WITH {NODES_SQL} SELECT node_id, 0.85::DOUBLE AS strength, false AS archived FROM nodes g WHERE archived
  AND EXISTS (SELECT 1 FROM nodes l WHERE NOT l.archived AND l.label = g.label AND list_cosine_similarity(l.v, g.v) >= 0.3)""",
    "life_index_hygiene": f"""WITH {NODES_SQL}, g AS (SELECT label, count(*) AS total, count(*) FILTER (archived) AS archived_rows FROM nodes GROUP BY label)
SELECT label, total, archived_rows, round(archived_rows / total, 6) AS ratio, archived_rows / total >= 0.1 AS alert FROM g""",
    "life_knowledge_gaps": """WITH l AS (SELECT doc_id % 45 AS domain, count(*) AS n, avg(quality) AS c FROM labels GROUP BY 1), m AS (SELECT user_id % 60 AS domain, count(*) AS m FROM events WHERE event_type = 'error' GROUP BY 1
), p AS (SELECT conv_id % 50 AS domain, count(*) AS p FROM conversations GROUP BY 1
), e AS (SELECT domain, coalesce(n, 0) AS n, coalesce(m, 0) AS m, coalesce(p, 0) AS p, c FROM l FULL JOIN m USING (domain) FULL JOIN p USING (domain)
), g AS (SELECT *, CASE WHEN n < 2 AND m > 5 THEN 'missing_lessons' WHEN p > 0 AND n = 0 THEN 'no_lessons_for_archetype' WHEN n > 0 AND c < 0.5 THEN 'low_quality' END AS gap FROM e
), s AS (SELECT *, CASE WHEN gap = 'low_quality' THEN least(1.0, m / n / 10) ELSE least(1.0, m / 10) END AS raw FROM g WHERE gap IS NOT NULL)
SELECT domain, gap, round(CASE WHEN gap = 'no_lessons_for_archetype' AND raw < 0.5 THEN 0.6 ELSE raw END, 6)::DOUBLE AS severity FROM s""",
    "life_prune_sessions": """WITH e AS (SELECT user_id * 10 + event_id % 10 AS session_id, event_id, ts FROM events
), s AS (SELECT session_id FROM e GROUP BY session_id HAVING coalesce(max(CASE WHEN session_id % 4 > 0 THEN ts END), min(ts)) < TIMESTAMP '2024-02-10' - INTERVAL 13 DAY)
SELECT session_id, event_id FROM e WHERE session_id NOT IN (SELECT session_id FROM s)""",
    "life_procedure_synthesis": """SELECT event_type || ':' || user_id AS strategy, count(*) AS plans, round(least(1.0, 1.1 * max((event_id % 100) / 100.0)), 6)::DOUBLE AS strength, round(avg((event_id % 7) / 7.0), 6)::DOUBLE AS confidence
FROM events WHERE value / 40 > 0.5 GROUP BY 1 HAVING count(*) >= 2""",
    "life_rescore": f"""WITH {NODES_SQL}, l AS (SELECT node_id AS src, node_id // 2 AS dst FROM nodes WHERE node_id > 0), b AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l
), a AS (SELECT b.src AS node_id, count(*) AS n, avg(strength) AS mean FROM b JOIN nodes x ON x.node_id = b.dst GROUP BY b.src
), c AS (SELECT node_id, n, confidence, least(confidence + least(0.05 * n, 0.30) + CASE WHEN mean > 0.7 THEN 0.1 ELSE 0 END, 0.99) AS new FROM nodes JOIN a USING (node_id))
SELECT node_id, n, round(new, 6)::DOUBLE AS new_confidence, new >= 0.9 AS promoted FROM c WHERE round(new - confidence, 9) >= 0.02""",
    "pattern_temporal": """WITH g AS (SELECT user_id || ':' || event_type AS key, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts)) / 1e6 AS gap FROM events
), a AS (SELECT key, count(*) AS n, count(*) FILTER (gap > 0) AS k, avg(gap) FILTER (gap > 0) AS m, stddev_pop(gap) FILTER (gap > 0) AS s FROM g GROUP BY key)
SELECT key, n, round(m, 3) AS mean_gap, round(s / m, 5) AS cv FROM a WHERE n >= 3 AND k >= 2 AND s / m <= 0.6""",
    "pattern_frequency": """WITH c AS (SELECT user_id || ':' || event_type AS key, CAST(ts AS DATE) AS d, count(*) AS y FROM events GROUP BY ALL
), x AS (SELECT key, y, row_number() OVER (PARTITION BY key ORDER BY d) - 1 AS x FROM c
), g AS (SELECT key, count(*) AS n, regr_slope(y, x) AS slope, max_by(y, x) AS last, avg(y) AS mean FROM x GROUP BY key)
SELECT key, n, round(slope, 6) AS slope, last, round(mean, 6) AS mean FROM g WHERE n >= 4 AND round(g.slope, 9) > 0 AND last > g.mean""",
    "pattern_sequence": """WITH w AS (SELECT lag(event_type, 2) OVER s AS a, lag(event_type, 1) OVER s AS b, event_type AS c FROM events WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT a AS first, b AS second, c AS failed, count(*) AS n FROM w WHERE c = 'error' AND a IS NOT NULL GROUP BY a, b, c HAVING count(*) >= 3""",
    "pattern_dedupe": """SELECT DISTINCT event_type || (user_id % 5) AS trigger FROM events WHERE user_id % 9 <> 0
EXCEPT SELECT event_type || (user_id % 3) FROM events WHERE value > 60""",
}
