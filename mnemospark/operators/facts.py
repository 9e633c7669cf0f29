"""Versioned facts and entities: new versions supersede old ones, nothing is overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The predicates a fact may have.
PREDICATES = ("INVOKES", "REQUIRES", "IMPLEMENTS", "READS", "WRITES", "CONSTRAINED_BY", "DEPLOYED_ON", "PRODUCED", "APPROVED_BY", "REUSES")


def versions(facts: DataFrame) -> DataFrame:
    """subject, predicate, object, version, at, superseded_by: arrivals that repeat the version before are no new rows.

    facts: subject, predicate, object, version, at, arrival (a total order). Facts of unknown predicates are left out.
    """
    w = Window.partitionBy("subject", "predicate", "object").orderBy("at", "arrival")
    known = facts.where(F.col("predicate").isin(*PREDICATES) & F.col("version").isNotNull())
    new = known.withColumn("before", F.lag("version").over(w)).where("before IS NULL OR before <> version").drop("before")
    return new.withColumn("superseded_by", F.lead("version").over(w))


def rejected(facts: DataFrame) -> DataFrame:
    """reason, n of the facts that versions() leaves out."""
    reason = F.when(F.col("version").isNull(), "missing_version").when(~F.col("predicate").isin(*PREDICATES), "unknown_predicate")
    return facts.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """key, version, value, action: created, refreshed (version differs) or kept. Both: key, version, value."""
    s, n = stored.alias("s"), incoming.alias("n")
    both = s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "full")
    action = F.when(F.col(f"s.{key}").isNull(), "created").when(F.col(f"n.{key}").isNotNull() & (F.col("s.version") != F.col("n.version")), "refreshed").otherwise("kept")
    take = action != "kept"
    return both.select(F.coalesce(f"s.{key}", f"n.{key}").alias(key), F.when(take, F.col("n.version")).otherwise(F.col("s.version")).alias("version"), F.when(take, F.col("n.value")).otherwise(F.col("s.value")).alias("value"), action.alias("action"))


def merge_counts(events: DataFrame) -> DataFrame:
    """a, b, count, strength of pairs merged in order: the first sets the strength, each later one halves the distance to its own.

    s_k = (s_(k-1) + x_k) / 2 in closed form: x_1 / 2**(n-1) + sum of x_k / 2**(n-k+1), so that sums are
    combined before the shuffle's end and no list of a pair's events is kept. events: a, b, at, strength.
    """
    w, all_ = Window.partitionBy("a", "b").orderBy("at"), Window.partitionBy("a", "b")
    placed = events.withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(all_))
    weight = F.when(F.col("k") == 1, F.pow(F.lit(0.5), F.col("n") - 1)).otherwise(F.pow(F.lit(0.5), F.col("n") - F.col("k") + 1))
    return placed.groupBy("a", "b").agg(F.count("*").alias("count"), F.sum(F.col("strength") * weight).alias("strength"))


def moves(snapshots: DataFrame) -> DataFrame:
    """entity, step, distance from the step before (to 4 places). snapshots: entity, step, row, col."""
    w = Window.partitionBy("entity").orderBy("step")
    d = [F.col(c) - F.lag(c).over(w) for c in ("row", "col")]
    return snapshots.select("entity", "step", F.round(F.hypot(*[x.cast("double") for x in d]), 4).alias("distance")).where("distance IS NOT NULL")


def untested(available: DataFrame, tested: DataFrame) -> DataFrame:
    """Available actions (context, position, action) that were not tested there; their order and repeats stay."""
    return available.join(tested.select("context", "action").distinct(), ["context", "action"], "left_anti").select("context", "position", "action")


def rollup_run(tasks: DataFrame, by: str) -> DataFrame:
    """by, tasks, solved, failed, steps, first_at, last_at, status. tasks: solved (boolean), steps, at."""
    g = tasks.groupBy(by).agg(F.count("*").alias("tasks"), F.count_if("solved").alias("solved"), F.sum("steps").alias("steps"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    status = F.when(F.col("solved") == F.col("tasks"), "solved").when(F.col("solved") > 0, "partial").otherwise("failed")
    return g.withColumn("failed", F.col("tasks") - F.col("solved")).withColumn("status", status)
