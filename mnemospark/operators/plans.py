"""Plans as a graph: normalised steps, one plan a content hash, rows for the tables that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import first_of_equals
from mnemospark.sources.versioned import Upsert
from mnemospark.storage import cut


def normal_steps(steps: Column) -> Column:
    """Trimmed steps without white space runs, crumbs of under three characters and repeats (case left aside)."""
    bare = F.filter(F.transform(steps, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s.isNotNull() & (F.length(s) >= 3))
    return first_of_equals(bare)


def content_hash(steps: Column) -> Column:
    """SHA-256 of the lower-cased steps, one a line."""
    return F.sha2(F.array_join(F.transform(steps, F.lower), "\n"), 256)


def plan_graph(declared: DataFrame) -> dict[str, Upsert]:
    """Rows for the tables plans, plan_steps and plan_edges.

    declared: session_id, at, goal, steps. Plans of equal steps are one plan:
    its goal and session are those of its first declaration (by at, then
    session_id), and `declared` counts all of them. Declarations without a
    step make no plan.
    """
    rows = declared.withColumn("steps", normal_steps(F.col("steps"))).where(F.size("steps") > 0).withColumn("plan_id", content_hash(F.col("steps")))
    first = Window.partitionBy("plan_id").orderBy("at", "session_id")
    # Stored once: three tables are made of it.
    plans = cut(rows.withColumn("place", F.row_number().over(first)).withColumn("declared", F.count("*").over(Window.partitionBy("plan_id"))).where("place = 1"), "plans")
    steps = plans.select("plan_id", F.posexplode("steps").alias("place", "text")).withColumn("step_id", F.sha2(F.concat_ws("#", "plan_id", F.col("place").cast("string")), 256))
    ids = steps.select("plan_id", "place", "step_id")
    following = F.lead("step_id").over(Window.partitionBy("plan_id").orderBy("place"))
    next_step = ids.select(F.col("step_id").alias("src"), following.alias("dst"), F.lit("NEXT_STEP").alias("rel_type")).where("dst IS NOT NULL")
    step_of = ids.select(F.col("step_id").alias("src"), F.col("plan_id").alias("dst"), F.lit("STEP_OF").alias("rel_type"))
    return {
        "plans": Upsert(plans.select("plan_id", "session_id", "at", "goal", F.size("steps").alias("n_steps"), "declared"), ["plan_id"]),
        "plan_steps": Upsert(steps.select("step_id", "plan_id", "place", "text"), ["step_id"]),
        "plan_edges": Upsert(step_of.unionByName(next_step), ["src", "dst", "rel_type"]),
    }


def detected(turns: DataFrame, least: int = 2) -> DataFrame:
    """Passive detection: assistant turns whose text lists `least` steps or more, under the user turn before as the goal.

    turns: session_id, turn, role, text. Returns session_id, at, goal, steps.
    """
    before = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    told = turns.withColumn("goal", before).where("role = 'assistant'").withColumn("steps", normal_steps(F.split("text", r"[.!?\n]")))
    return told.where(F.size("steps") >= least).select("session_id", F.col("turn").alias("at"), F.coalesce("goal", F.lit("")).alias("goal"), "steps")
