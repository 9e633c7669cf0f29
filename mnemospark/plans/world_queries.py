"""Queries of the world model, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import world
from mnemospark.sources.memory_tables import table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("at", F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id"))


def world_hypotheses(spark, sf_dir):
    e = _events(spark, sf_dir).select((F.col("user_id") % 60).alias("hypothesis"), "at", F.col("event_type").isin("purchase", "click", "view").alias("confirms"), (F.coalesce("value", F.lit(1.0)) / 50).alias("weight"))
    return world.hypotheses(e).withColumn("confidence", F.round("confidence", 6))


def _rules(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.concat_ws(":", (F.col("user_id") % 40).cast("string"), "event_type").alias("key"), "at", (F.floor(F.coalesce("value", F.lit(0.0)) / 30) % 3).alias("to"))
    return world.rules(e)


def world_rules(spark, sf_dir):
    return _rules(spark, sf_dir).select("key", "to", F.col("created_at.event_id").alias("created"), "confidence", "falsified")


def world_live_rules(spark, sf_dir):
    """What holds now, by action."""
    return _rules(spark, sf_dir).where("NOT falsified").select(F.split("key", ":")[1].alias("action"), F.split("key", ":")[0].cast("int").alias("task"), "to", "confidence")


def world_transferred_rules(spark, sf_dir):
    learned = _rules(spark, sf_dir).select(F.split("key", ":")[0].cast("int").alias("task"), F.concat_ws(":", F.split("key", ":")[1], F.split("key", ":")[0].cast("int") % 7).alias("fingerprint"), "to", "confidence", "falsified")
    return world.transferred(learned, "task")


def world_goal_gate(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("goal"), "at", (F.coalesce("value", F.lit(0.0)) / 100).alias("confidence"), (F.col("event_type") == "purchase").alias("progress"))
    return world.goal_gate(e).withColumn("confidence", F.round("confidence", 6))


def _outcomes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("task"), F.col("o_orderpriority").alias("action"), "o_orderkey", (F.col("o_orderkey") % 11 / 10.0).alias("predicted"), (F.col("o_orderkey") * 7 % 13 / 12.0).alias("actual"))


def world_reward_errors(spark, sf_dir):
    return world.reward_errors(_outcomes(spark, sf_dir), 0.3).select("o_orderkey", "error", "direction")


def world_plan_errors(spark, sf_dir):
    """How plans turned out against what was expected of them, with the narrow band."""
    e = world.reward_errors(_outcomes(spark, sf_dir), 0.1)
    return e.groupBy("action", "direction").agg(F.count("*").alias("n"), F.round(F.avg("error"), 6).alias("mean_error"))


def world_falsified_actions(spark, sf_dir):
    errors = world.reward_errors(_outcomes(spark, sf_dir), 0.3)
    kinds = errors.groupBy("task").agg(F.count_distinct("action").alias("n"))
    return world.falsified_actions(errors, kinds.where("n < 5"), 2)


def world_transitions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("task"), "event_type", (F.col("event_id") % 7).alias("entity"), "event_id", F.round("value", 4).alias("value"))
    return world.transitions(e, ["task", "event_type", "entity"], "event_id")


def world_causal_paths(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst"), (F.col("n_nationkey") % 5 / 4.0).alias("confidence"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("src"), F.col("c_custkey").alias("dst"), (F.col("c_custkey") % 9 / 8.0).alias("confidence"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderpriority").alias("dst"), (F.col("o_orderkey") % 6 / 5.0).alias("confidence"))
    return world.causal_paths(n, c, o)


def world_action_effects(spark, sf_dir):
    """Each action's observed effects with how often they were seen and when last."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", (F.col("event_id") % 17).alias("effect")).agg(F.count("*").alias("observations"), F.max("event_id").alias("last_seen"))


def metric_regressions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("variant"), (F.col("o_orderstatus") != "F").alias("failed"), (F.col("o_orderkey") % 4 == 0).alias("regressed"))
    return world.regressions(o)


def metric_helped_tasks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    base = o.select(F.col("o_orderkey").alias("task"), (F.col("o_orderkey") % 3 > 0).alias("correct"), (F.col("o_orderkey") % 7).alias("steps"))
    variant = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("task"), (F.col("o_orderkey") % 5 > 0).alias("correct"), (F.col("o_orderkey") % 4).alias("steps"))
    return world.helped(base, variant)


QUERIES = {
    f.__name__: f
    for f in (
        world_hypotheses, world_rules, world_live_rules, world_transferred_rules, world_goal_gate, world_reward_errors, world_plan_errors, world_falsified_actions, world_transitions, world_causal_paths,
        world_action_effects, metric_regressions, metric_helped_tasks,
    )
}

#: Rules one signature at a time: `live` is the live rule's value, `n` its confirmations, `born` its first signature.
_RULES = """RECURSIVE s AS (SELECT (user_id % 40) || ':' || event_type AS key, CAST(floor(coalesce(value, 0) / 30) AS BIGINT) % 3 AS "to", event_id, row_number() OVER (PARTITION BY user_id % 40, event_type ORDER BY ts, event_id) AS k FROM events
), f AS (SELECT key, k, "to" AS live, 0 AS n, event_id AS born, CAST(NULL AS BIGINT) AS dead, 0 AS dead_n, CAST(NULL AS BIGINT) AS dead_born FROM s WHERE k = 1
  UNION ALL SELECT s.key, s.k, CASE WHEN live IS NULL THEN s."to" WHEN live = s."to" THEN live END, CASE WHEN live IS NULL THEN 0 WHEN live = s."to" THEN n + 1 END, CASE WHEN live IS NULL THEN s.event_id WHEN live = s."to" THEN born END,
    CASE WHEN live <> s."to" THEN live END, CASE WHEN live <> s."to" THEN n END, CASE WHEN live <> s."to" THEN born END FROM f JOIN s ON s.key = f.key AND s.k = f.k + 1
), l AS (SELECT key, max(k) AS k FROM f GROUP BY key
), rules AS (SELECT key, dead AS "to", dead_born AS created, round(least(1.0, 0.5 + 0.1 * dead_n), 6)::DOUBLE AS confidence, true AS falsified FROM f WHERE dead IS NOT NULL
  UNION ALL SELECT key, live, born, round(least(1.0, 0.5 + 0.1 * n), 6)::DOUBLE, false FROM f JOIN l USING (key, k) WHERE live IS NOT NULL)"""
_OUT = "o AS (SELECT o_custkey AS task, o_orderpriority AS action, o_orderkey, round(o_orderkey * 7 % 13 / 12 - o_orderkey % 11 / 10, 6) AS error FROM orders)"

ORACLE_SQL = {
    "world_hypotheses": """WITH RECURSIVE s AS (SELECT user_id % 60 AS h, event_type IN ('purchase', 'click', 'view') AS up, coalesce(value, 1) / 50 AS w, row_number() OVER (PARTITION BY user_id % 60 ORDER BY ts, event_id) AS k FROM events
), d AS (SELECT h, k, up, CASE WHEN up THEN least(0.1, w * 0.05) ELSE -least(0.15, w * 0.1) END AS d FROM s
), f AS (SELECT h, 0::BIGINT AS k, 0.5::DOUBLE AS c, false AS low FROM (SELECT DISTINCT h FROM d) UNION ALL
  SELECT f.h, d.k, least(1.0, greatest(0.0, c + d)), low OR (NOT up AND round(greatest(0.0, c + d), 9) < 0.1) FROM f JOIN d ON d.h = f.h AND d.k = f.k + 1)
SELECT h AS hypothesis, max(k) AS evidence_count, round(max_by(c, k), 6) AS confidence, bool_or(low) AS demoted FROM f GROUP BY h""",
    "world_rules": f"WITH {_RULES} SELECT * FROM rules",
    "world_live_rules": f"""WITH {_RULES} SELECT split_part(key, ':', 2) AS action, CAST(split_part(key, ':', 1) AS INTEGER) AS task, "to", confidence FROM rules WHERE NOT falsified""",
    "world_transferred_rules": f"""WITH {_RULES}, lr AS (SELECT CAST(split_part(key, ':', 1) AS INTEGER) AS task, split_part(key, ':', 2) || ':' || CAST(split_part(key, ':', 1) AS INTEGER) % 7 AS fingerprint, "to", confidence, falsified FROM rules
), t AS (SELECT DISTINCT task, fingerprint FROM lr) SELECT t.fingerprint, t.task, lr.task AS other_task, "to", confidence FROM t JOIN lr ON lr.fingerprint = t.fingerprint AND lr.task <> t.task WHERE NOT falsified""",
    "world_goal_gate": """WITH RECURSIVE s AS (SELECT user_id AS goal, coalesce(value, 0) / 100 AS c, event_type = 'purchase' AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
), f AS (SELECT goal, 0::BIGINT AS k, 0.0::DOUBLE AS now FROM (SELECT DISTINCT goal FROM s) UNION ALL SELECT s.goal, s.k, CASE WHEN s.c > now AND NOT p THEN now ELSE s.c END FROM f JOIN s ON s.goal = f.goal AND s.k = f.k + 1)
SELECT goal, round(max_by(now, k), 6) AS confidence FROM f GROUP BY goal""",
    "world_reward_errors": f"WITH {_OUT} SELECT o_orderkey, error, CASE WHEN error > 0.3 THEN 'positive' WHEN error < -0.3 THEN 'negative' ELSE 'neutral' END AS direction FROM o",
    "world_plan_errors": f"WITH {_OUT} SELECT action, CASE WHEN error > 0.1 THEN 'positive' WHEN error < -0.1 THEN 'negative' ELSE 'neutral' END AS direction, count(*) AS n, round(avg(error), 6) AS mean_error FROM o GROUP BY ALL",
    "world_falsified_actions": f"""WITH {_OUT}, u AS (SELECT task FROM o GROUP BY task HAVING count(DISTINCT action) < 5), g AS (SELECT task, action, count(*) FILTER (error < -0.3) AS falsified FROM o GROUP BY ALL)
SELECT task, action, falsified, NOT (falsified >= 2 AND task IN (SELECT task FROM u)) AS go FROM g""",
    "world_transitions": """SELECT user_id % 50 AS task, event_type, event_id % 7 AS entity, max(event_id) AS event_id, round(max_by(value, event_id), 4) AS value FROM events GROUP BY ALL""",
    "world_causal_paths": """SELECT n_regionkey AS source, o_orderpriority AS target, count(*) AS paths, max(least(n_nationkey % 5 / 4, c_custkey % 9 / 8, o_orderkey % 6 / 5))::DOUBLE AS confidence
FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL""",
    "world_action_effects": "SELECT event_type, event_id % 17 AS effect, count(*) AS observations, max(event_id) AS last_seen FROM events GROUP BY ALL",
    "metric_regressions": """WITH g AS (SELECT o_orderpriority AS variant, count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS failed, count(*) FILTER (o_orderstatus <> 'F' AND o_orderkey % 4 = 0) AS back FROM orders GROUP BY 1)
SELECT variant, round((n - failed) / n, 6) AS success_rate, round(coalesce(back / nullif(failed, 0), 0), 6) AS regression_rate FROM g""",
    "metric_helped_tasks": """SELECT o_orderkey AS task, CASE WHEN o_orderkey % 3 = 0 THEN 'baseline failed' ELSE 'fewer steps: ' || (o_orderkey % 7) || ' to ' || (o_orderkey % 4) END AS reason
FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 > 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 4 < o_orderkey % 7)""",
}
