"""Queries of sequences, working sets, metrics and versioned facts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import facts, metrics, sequences
from mnemospark.sources.memory_tables import messages, nodes, table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def seq_followed_by(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("message_id"), F.unix_micros("ts").alias("at"))
    return sequences.followed_by(e).select("src", "dst", F.round(F.col("gap_seconds") / 1e6, 6).alias("gap_seconds"))


def seq_decision_chain(spark, sf_dir):
    e = _events(spark, sf_dir).where("event_type = 'purchase'")
    return sequences.decision_chain(e.select(F.col("event_id").alias("decision_id"), F.col("user_id").alias("session_id"), F.col("ts").alias("at")))


def seq_timeline(spark, sf_dir):
    return sequences.timeline(messages(spark, sf_dir), F.col("role") == "assistant", 4)


def seq_prior_session(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("session_id", F.col("user_id") * 100 + F.dayofmonth("ts"))
    return sequences.prior_session(e.groupBy(F.col("user_id").alias("quest_id"), "session_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_active_at")))


def seq_diff_since(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return sequences.changes_since(e, F.lit("2024-01-20 00:00:00").cast("timestamp"), 20).select("kind", "id")


def _loads(spark, sf_dir):
    node = F.col("event_id") % 37
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), node.alias("node_id"), (node * 11).alias("tokens"))


def seq_working_set(spark, sf_dir):
    return sequences.working_set(_loads(spark, sf_dir))


def seq_session_tokens(spark, sf_dir):
    out = sequences.session_tokens(_loads(spark, sf_dir), 8000)
    return out.withColumn("utilization", F.round("utilization", 6))


def seq_handoff(spark, sf_dir):
    loads = _loads(spark, sf_dir)
    prior = loads.select("session_id").distinct().where("session_id > 0").withColumn("prior_id", F.col("session_id") - 1)
    return sequences.handoff(loads, nodes(spark, sf_dir), prior)


def seq_first_of_group(spark, sf_dir):
    return sequences.first_of_group(table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("line")), "l_orderkey", "line").select("l_orderkey", "line.l_partkey", "rn")


def _sections(spark, sf_dir):
    return messages(spark, sf_dir).select("session_id", F.col("turn").alias("position"), F.floor(F.length(F.coalesce("text", F.lit(""))) / 3).alias("tokens"))


def seq_fill_budget(spark, sf_dir):
    return sequences.fill_budget(_sections(spark, sf_dir), "session_id", 300)


def seq_staged_budget(spark, sf_dir):
    return sequences.staged_budget(_sections(spark, sf_dir), "session_id", 300).select("session_id", "position", "before")


def seq_prune_lowest(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "A").alias("protected"))
    return sequences.prune_lowest(l, "l_orderkey").select("l_orderkey", "id.l_linenumber", "id.l_partkey")


def metric_priors(spark, sf_dir):
    return metrics.priors(table(spark, sf_dir, "events").select("user_id", (F.col("value") / 50).alias("progress")), "user_id")


def metric_rates(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_orderstatus") == "F").alias("solved"), (F.col("o_orderstatus") == "P").alias("error"), (k % 3).alias("violations"), (k % 7).alias("depth"))
    return metrics.rates(o, "o_orderpriority")


def metric_z_test(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 2).cast("string").alias("variant"), (F.col("event_type") == "error").alias("failed"))
    return metrics.z_test(e, "0", "1").select(F.round("z", 6).alias("z"))


def metric_percent_change(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("a"), F.count_if(F.col("event_type") == "click").alias("b"))
    return e.select("user_id", metrics.percent_change(F.col("a").cast("double"), F.col("b").cast("double")).alias("change"))


def metric_running_overlap(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("stream"), F.col("l_orderkey").alias("position"), (F.col("l_partkey") % 50).alias("constraint_id"))
    return metrics.running_overlap(l).withColumn("recall", F.round("recall", 6))


def _facts(spark, sf_dir):
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("subject"), F.when(line == 7, "ENDORSES").otherwise("INVOKES").alias("predicate"), F.col("l_partkey").alias("object"), F.when(F.col("l_orderkey") % 40 > 0, F.col("l_returnflag")).alias("version"),
        F.col("l_shipdate").alias("at"), F.struct("l_orderkey", "l_linenumber").alias("arrival"),
    )


def fact_versions(spark, sf_dir):
    return facts.versions(_facts(spark, sf_dir)).select("subject", "object", "version", "superseded_by", "arrival.l_orderkey", "arrival.l_linenumber")


def fact_rejected(spark, sf_dir):
    return facts.rejected(_facts(spark, sf_dir))


def fact_entity_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    stored = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("version"), F.col("c_acctbal").alias("value"))
    shift = F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(100_000)
    incoming = c.where("c_custkey % 3 = 0").select((F.col("c_custkey") + shift).alias("id"), F.when(F.col("c_custkey") % 4 == 0, "v2").otherwise(F.col("c_mktsegment")).alias("version"), (F.col("c_acctbal") + 1).alias("value"))
    return facts.upsert(stored, incoming, "id").withColumn("value", F.round("value", 4))


def fact_merge_counts(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("a"), F.col("event_type").alias("b"), F.struct("ts", "event_id").alias("at"), (F.col("value") / 100).alias("strength"))
    return facts.merge_counts(e).withColumn("strength", F.round("strength", 6))


def world_moves(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("step"), (F.col("event_id") % 10).alias("row"), (F.col("event_id") * 7 % 13).alias("col"))
    return facts.moves(e)


def world_untested_actions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kinds = F.array(*map(F.lit, ["view", "click", "refund", "error", "refund"]))
    return facts.untested(e.select(F.col("user_id").alias("context")).distinct().select("context", F.posexplode(kinds).alias("position", "action")), e.select(F.col("user_id").alias("context"), F.col("event_type").alias("action")))


def world_run_rollup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), (F.col("o_orderstatus") == "F").alias("solved"), (F.col("o_orderkey") % 5).alias("steps"), F.col("o_orderkey").alias("at"))
    return facts.rollup_run(o, "run")


QUERIES = {
    f.__name__: f
    for f in (
        seq_followed_by, seq_decision_chain, seq_timeline, seq_prior_session, seq_diff_since, seq_working_set, seq_session_tokens, seq_handoff, seq_first_of_group, seq_fill_budget, seq_staged_budget, seq_prune_lowest,
        metric_priors, metric_rates, metric_z_test, metric_percent_change, metric_running_overlap, fact_versions, fact_rejected, fact_entity_upsert, fact_merge_counts, world_moves, world_untested_actions, world_run_rollup,
    )
}

_LOADS = "l AS (SELECT user_id AS session_id, event_id % 37 AS node_id, event_id % 37 * 11 AS tokens FROM events), w AS (SELECT session_id, node_id, count(*) AS load_hits, max(tokens) AS tokens, max(tokens) * (count(*) - 1) AS dedup_saved FROM l GROUP BY ALL)"
_SECTIONS = "s AS (SELECT conv_id AS session_id, turn AS position, coalesce(length(text), 0) // 3 AS tokens FROM conversations)"
_FACTS = "f AS (SELECT l_suppkey AS subject, l_linenumber = 7 AS odd, l_partkey AS object, CASE WHEN l_orderkey % 40 > 0 THEN l_returnflag END AS version, l_shipdate AS shipped, l_orderkey, l_linenumber FROM lineitem)"

ORACLE_SQL = {
    "seq_followed_by": """SELECT * FROM (SELECT lag(event_id) OVER w AS src, event_id AS dst, round((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 6) AS gap_seconds FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE src IS NOT NULL""",
    "seq_decision_chain": """SELECT user_id AS session_id, event_id AS decision_id, lag(event_id) OVER w AS prev_id, CAST(row_number() OVER w AS INTEGER) AS step_number FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "seq_timeline": """WITH s AS (SELECT conv_id, min(turn) AS start FROM conversations WHERE role = 'assistant' GROUP BY conv_id
), a AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS hop FROM conversations JOIN s USING (conv_id) WHERE turn >= start)
SELECT conv_id AS session_id, conv_id * 10000 + turn AS message_id, hop, max(hop) OVER (PARTITION BY conv_id) >= 4 AS truncated FROM a WHERE hop <= 4""",
    "seq_prior_session": """WITH s AS (SELECT user_id, user_id * 100 + day(ts) AS session_id, min(ts) AS a, max(ts) AS z FROM events GROUP BY ALL)
SELECT x.session_id, max_by(y.session_id, (y.z, y.session_id)) AS prior_id FROM s x JOIN s y ON x.user_id = y.user_id AND x.session_id <> y.session_id AND y.z < x.a GROUP BY x.session_id""",
    "seq_diff_since": """SELECT kind, id FROM (SELECT event_type AS kind, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rn FROM events WHERE ts > TIMESTAMP '2024-01-20') WHERE rn <= 20""",
    "seq_working_set": f"WITH {_LOADS} SELECT * FROM w",
    "seq_session_tokens": f"""WITH {_LOADS}, g AS (SELECT session_id, CAST(sum(tokens) AS BIGINT) AS estimate, CAST(sum(dedup_saved) AS BIGINT) AS dedup_saved FROM w GROUP BY session_id)
SELECT session_id, estimate, dedup_saved, estimate + dedup_saved AS baseline, round(estimate / 8000, 6) AS utilization, estimate / 8000 > 0.75 AS bloated FROM g""",
    "seq_handoff": f"""WITH {_LOADS}, h AS (SELECT DISTINCT x.session_id, w.node_id FROM (SELECT DISTINCT session_id FROM l WHERE session_id > 0) x JOIN w ON w.session_id = x.session_id - 1
), r AS (SELECT session_id, node_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY vec_id % 50 DESC, node_id) AS INTEGER) AS rank FROM h JOIN embeddings ON vec_id = node_id WHERE vec_id % 11 <> 0) SELECT * FROM r WHERE rank <= 5""",
    "seq_first_of_group": """SELECT l_orderkey, l_partkey, rn FROM (SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS rn,
  count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE n >= 3 AND rn <= 5""",
    "seq_fill_budget": f"WITH {_SECTIONS} SELECT * FROM (SELECT *, CAST(sum(tokens) OVER (PARTITION BY session_id ORDER BY position) AS BIGINT) AS used FROM s) WHERE used <= 300",
    "seq_staged_budget": f"""WITH {_SECTIONS}, b AS (SELECT session_id, position, CAST(coalesce(sum(tokens) OVER (PARTITION BY session_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM s)
SELECT * FROM b WHERE before < 270""",
    "seq_prune_lowest": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey FROM r WHERE rn <= greatest(1, n - floor(n * 0.3)) OR l_returnflag = 'A'""",
    "metric_priors": """SELECT user_id, count(*) AS evidence_count, round(avg(least(1.0, greatest(0.0, value / 50))), 4) AS mean, round(median(least(1.0, greatest(0.0, value / 50))), 4) AS median FROM events WHERE value IS NOT NULL GROUP BY user_id""",
    "metric_rates": """SELECT o_orderpriority, count(*) AS tasks, round(avg(CAST(o_orderstatus = 'F' AS INTEGER)), 4) AS solve_rate, round(avg(CAST(o_orderstatus = 'P' AS INTEGER)), 4) AS error_rate,
  round(greatest(0.0, 1 - sum(o_orderkey % 3) / sum(greatest(1, floor(o_orderkey % 7 * 1.5)))), 4)::DOUBLE AS constraint_consistency, round(coalesce(avg(o_orderkey % 7) FILTER (o_orderstatus = 'F'), 0), 4) AS chain_depth FROM orders GROUP BY o_orderpriority""",
    "metric_z_test": """WITH g AS (SELECT count(*) FILTER (user_id % 2 = 0) AS n0, count(*) FILTER (user_id % 2 = 1) AS n1, count(*) FILTER (user_id % 2 = 0 AND event_type = 'error') AS x0, count(*) FILTER (user_id % 2 = 1 AND event_type = 'error') AS x1 FROM events
), p AS (SELECT *, (x0 + x1) / (n0 + n1) AS p FROM g) SELECT round((x0 / n0 - x1 / n1) / sqrt(p * (1 - p) * (1 / n0 + 1 / n1)), 6) AS z FROM p""",
    "metric_percent_change": """WITH g AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'click') AS b FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN a = 0 AND b = 0 THEN '+0.0%' WHEN a = 0 THEN '+inf' ELSE format('{:+.1f}%', (b - a) * 100 / a) END AS change FROM g""",
    "metric_running_overlap": """WITH t AS (SELECT DISTINCT l_suppkey AS stream, l_orderkey AS position, l_partkey % 50 AS c FROM lineitem), k AS (SELECT *, min(position) OVER (PARTITION BY stream, c) < position AS known FROM t)
SELECT stream, position, round(avg(CAST(known AS INTEGER)), 6) AS recall FROM k GROUP BY stream, position""",
    "fact_versions": f"""WITH {_FACTS}, k AS (SELECT *, lag(version) OVER (PARTITION BY subject, object ORDER BY shipped, l_orderkey, l_linenumber) AS before FROM f WHERE NOT odd AND version IS NOT NULL
), n AS (SELECT * FROM k WHERE before IS NULL OR before <> version)
SELECT subject, object, version, lead(version) OVER (PARTITION BY subject, object ORDER BY shipped, l_orderkey, l_linenumber) AS superseded_by, l_orderkey, l_linenumber FROM n""",
    "fact_rejected": f"WITH {_FACTS} SELECT CASE WHEN version IS NULL THEN 'missing_version' ELSE 'unknown_predicate' END AS reason, count(*) AS n FROM f WHERE odd OR version IS NULL GROUP BY 1",
    "fact_entity_upsert": """WITH n AS (SELECT c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 100000 END AS id, CASE WHEN c_custkey % 4 = 0 THEN 'v2' ELSE c_mktsegment END AS version, c_acctbal + 1 AS value FROM customer WHERE c_custkey % 3 = 0
), b AS (SELECT coalesce(c_custkey, id) AS id, c_mktsegment AS v1, c_acctbal AS x1, version AS v2, value AS x2, CASE WHEN c_custkey IS NULL THEN 'created' WHEN n.id IS NOT NULL AND c_mktsegment <> version THEN 'refreshed' ELSE 'kept' END AS action FROM customer FULL JOIN n ON c_custkey = n.id)
SELECT id, CASE WHEN action = 'kept' THEN v1 ELSE v2 END AS version, round(CASE WHEN action = 'kept' THEN x1 ELSE x2 END, 4) AS value, action FROM b""",
    "fact_merge_counts": """WITH RECURSIVE e AS (SELECT user_id AS a, event_type AS b, value / 100 AS x, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events
), f AS (SELECT a, b, k, x AS s FROM e WHERE k = 1 UNION ALL SELECT e.a, e.b, e.k, (f.s + e.x) / 2 FROM f JOIN e ON e.a = f.a AND e.b = f.b AND e.k = f.k + 1)
SELECT a, b, count(*) AS count, round(max_by(s, k), 6) AS strength FROM f GROUP BY a, b""",
    "world_moves": """WITH p AS (SELECT user_id AS entity, event_id AS step, event_id % 10 AS r, event_id * 7 % 13 AS c FROM events), d AS (SELECT entity, step, r - lag(r) OVER w AS dr, c - lag(c) OVER w AS dc FROM p WINDOW w AS (PARTITION BY entity ORDER BY step))
SELECT entity, step, round(sqrt(dr * dr + dc * dc), 4) AS distance FROM d WHERE dr IS NOT NULL""",
    "world_untested_actions": """WITH a(position, action) AS (VALUES (0, 'view'), (1, 'click'), (2, 'refund'), (3, 'error'), (4, 'refund')), u AS (SELECT DISTINCT user_id AS context FROM events)
SELECT context, position, action FROM u, a WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = context AND e.event_type = action)""",
    "world_run_rollup": """SELECT o_custkey AS run, count(*) AS tasks, count(*) FILTER (o_orderstatus = 'F') AS solved, CAST(sum(o_orderkey % 5) AS BIGINT) AS steps, min(o_orderkey) AS first_at, max(o_orderkey) AS last_at, count(*) - count(*) FILTER (o_orderstatus = 'F') AS failed,
  CASE WHEN count(*) = count(*) FILTER (o_orderstatus = 'F') THEN 'solved' WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'partial' ELSE 'failed' END AS status FROM orders GROUP BY o_custkey""",
}
