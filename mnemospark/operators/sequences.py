"""Order within sessions: gaps, chains, working sets, budgets, change feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def followed_by(messages: DataFrame) -> DataFrame:
    """Edges to each message from the one before it in its session: src, dst, gap_seconds. messages: session_id, message_id, at (seconds)."""
    w = Window.partitionBy("session_id").orderBy("at", "message_id")
    out = messages.select(F.lag("message_id").over(w).alias("src"), F.col("message_id").alias("dst"), (F.col("at") - F.lag("at").over(w)).alias("gap_seconds"))
    return out.where("src IS NOT NULL")


def decision_chain(decisions: DataFrame) -> DataFrame:
    """prev_id and step_number of each decision (decision_id, session_id, at)."""
    w = Window.partitionBy("session_id").orderBy("at", "decision_id")
    return decisions.select("session_id", "decision_id", F.lag("decision_id").over(w).alias("prev_id"), F.row_number().over(w).alias("step_number"))


def timeline(messages: DataFrame, match: Column, most: int = 20) -> DataFrame:
    """From the first match of each session, it and the next messages: session_id, message_id, hop, truncated. messages: session_id, turn, message_id."""
    start = messages.where(match).groupBy("session_id").agg(F.min("turn").alias("start"))
    w = Window.partitionBy("session_id").orderBy("turn")
    ahead = messages.join(start, "session_id").where(F.col("turn") >= F.col("start")).withColumn("hop", F.row_number().over(w) - 1)
    kept = ahead.where(F.col("hop") <= most)
    return kept.withColumn("truncated", F.max("hop").over(Window.partitionBy("session_id")) >= most).select("session_id", "message_id", "hop", "truncated")


def prior_session(sessions: DataFrame) -> DataFrame:
    """As of: the session of the same quest that was last active before each one started. sessions: quest_id, session_id, started_at, last_active_at."""
    ends = sessions.select("quest_id", F.col("last_active_at").alias("at"), F.lit(1).alias("is_end"), "session_id")
    starts = sessions.select("quest_id", F.col("started_at").alias("at"), F.lit(0).alias("is_end"), "session_id")
    # At one time starts come before ends, so an end is seen by later starts only.
    w = Window.partitionBy("quest_id").orderBy("at", "is_end", "session_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = ends.unionByName(starts).withColumn("prior", F.max(F.when(F.col("is_end") == 1, F.struct("at", "session_id"))).over(w))
    return seen.where("is_end = 0 AND prior IS NOT NULL").select("session_id", F.col("prior.session_id").alias("prior_id"))


def changes_since(rows: DataFrame, since: Column, most: int) -> DataFrame:
    """The newest rows of each kind after `since`: kind, id, at."""
    w = Window.partitionBy("kind").orderBy(F.desc("at"), "id")
    return rows.where(F.col("at") > since).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


def working_set(loads: DataFrame) -> DataFrame:
    """session_id, node_id, load_hits, dedup_saved = tokens (hits - 1). loads: session_id, node_id, tokens."""
    g = loads.groupBy("session_id", "node_id").agg(F.count("*").alias("load_hits"), F.max("tokens").alias("tokens"))
    return g.withColumn("dedup_saved", F.col("tokens") * (F.col("load_hits") - 1))


def session_tokens(loads: DataFrame, limit: int = 128_000, bloat: float = 0.75) -> DataFrame:
    """session_id, estimate, dedup_saved, baseline, utilization, bloated."""
    g = working_set(loads).groupBy("session_id").agg(F.sum("tokens").alias("estimate"), F.sum("dedup_saved").alias("dedup_saved"))
    used = F.col("estimate") / F.lit(limit)
    return g.select("session_id", "estimate", "dedup_saved", (F.col("estimate") + F.col("dedup_saved")).alias("baseline"), used.alias("utilization"), (used > bloat).alias("bloated"))


def handoff(loads: DataFrame, nodes: DataFrame, prior: DataFrame, most: int = 5) -> DataFrame:
    """What the session before had loaded and is live, strongest first: session_id, node_id, rank. prior: session_id, prior_id."""
    had = prior.join(loads.select(F.col("session_id").alias("prior_id"), "node_id").distinct(), "prior_id")
    live = had.join(nodes.where("NOT archived").select("node_id", "strength"), "node_id")
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("strength"), "node_id"))
    return live.withColumn("rank", rank).where(F.col("rank") <= most).select("session_id", "node_id", "rank")


def first_of_group(items: DataFrame, by: str, order: str, least: int = 3, most: int = 5) -> DataFrame:
    """The first `most` items of each group that has `least` or more."""
    w = Window.partitionBy(by).orderBy(order)
    counted = items.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(by)))
    return counted.where((F.col("n") >= least) & (F.col("rn") <= most)).drop("n")


def fill_budget(entries: DataFrame, by: str, budget: int) -> DataFrame:
    """The entries before the first one of each group that exceeds what is left. entries: by, position, tokens."""
    w = Window.partitionBy(by).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= budget)


def staged_budget(sections: DataFrame, by: str, budget: int, stop: float = 0.90) -> DataFrame:
    """Sections are taken while the tokens before them are under `stop` of the budget; the last may overshoot it."""
    w = Window.partitionBy(by).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return sections.withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0))).where(F.col("before") < stop * budget)


def prune_lowest(rows: DataFrame, by: str, part: float = 0.30) -> DataFrame:
    """All but the lowest int(n * part) by score of each group; one at least stays, protected rows always."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    n = F.count("*").over(Window.partitionBy(by))
    ranked = rows.withColumn("rn", F.row_number().over(w)).withColumn("keep_n", F.greatest(F.lit(1), n - F.floor(n * part)))
    return ranked.where((F.col("rn") <= F.col("keep_n")) | F.col("protected")).drop("rn", "keep_n")
