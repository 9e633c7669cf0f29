"""World-model folds: confidences, rules and transitions that change with each observation, as windows and associative steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.storage import cut

#: Observations that one array holds while they are folded.
CHUNK = 1024


def _compose(f: Column, g: Column) -> Column:
    """First f, then g. A step maps x to clamp(x + d, lo, hi), and demotes where x is under t."""
    clamp = lambda v: F.least(g["hi"], F.greatest(g["lo"], v + g["d"]))
    never, always = F.lit(float("-inf")), F.lit(float("inf"))
    later = F.when(g["t"] > f["hi"], always).when(g["t"] <= f["lo"], never).otherwise(g["t"] - f["d"])
    return F.struct((f["d"] + g["d"]).alias("d"), clamp(f["lo"]).alias("lo"), clamp(f["hi"]).alias("hi"), F.greatest(f["t"], later).alias("t"))


def clamped_fold(steps: DataFrame, key: str) -> DataFrame:
    """key, n and step: all steps (key, at, step) of each key composed in order.

    Clamped additions compose to one clamped addition, so they are folded in
    chunks of CHUNK, then chunks of chunks: no key's observations need fit one
    array. step: struct of d, lo, hi, t.
    """
    rows = steps.select(key, "at", "step", F.lit(1).cast("long").alias("n"))
    start = F.struct(F.lit(0.0).alias("d"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(float("-inf")).alias("t"))
    while True:
        place = F.row_number().over(Window.partitionBy(key).orderBy("at"))
        chunked = rows.withColumn("place", place).withColumn("chunk", F.floor((F.col("place") - 1) / CHUNK))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "step"))), lambda x: x["step"])
        rows = chunked.groupBy(key, F.col("chunk").alias("at")).agg(F.sum("n").alias("n"), ordered.alias("steps"))
        rows = cut(rows.select(key, "at", F.aggregate("steps", start, _compose).alias("step"), "n"), "folded")
        if rows.where("at > 0").isEmpty():
            return rows.select(key, "n", "step")


def hypotheses(observations: DataFrame, start: float = 0.5, demote: float = 0.1) -> DataFrame:
    """hypothesis, evidence_count, confidence, demoted. observations: hypothesis, at, confirms (boolean), weight.

    Confirmed: + min(0.1, 0.05 weight), 1 at most. Contradicted: - min(0.15,
    0.1 weight), 0 at least, and demoted for good where that leaves less than `demote`.
    """
    up, down = F.least(F.lit(0.1), F.col("weight") * 0.05), F.least(F.lit(0.15), F.col("weight") * 0.1)
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    step = F.struct(
        F.when(F.col("confirms"), up).otherwise(-down).alias("d"), F.when(F.col("confirms"), low).otherwise(0.0).alias("lo"),
        F.when(F.col("confirms"), 1.0).otherwise(high).alias("hi"), F.when(F.col("confirms"), low).otherwise(demote + down).alias("t"),
    )
    g = clamped_fold(observations.select("hypothesis", "at", step.alias("step")), "hypothesis")
    end = F.least(F.col("step.hi"), F.greatest(F.col("step.lo"), F.lit(start) + F.col("step.d")))
    # Within rounding noise of the threshold is not under it.
    return g.select("hypothesis", F.col("n").alias("evidence_count"), end.alias("confidence"), (F.lit(start) < F.col("step.t") - 1e-9).alias("demoted"))


def rules(signatures: DataFrame) -> DataFrame:
    """key, to, created_at, confidence, falsified of every rule ever learned. signatures: key, at, to.

    A signature without a live rule makes one (0.5); one that agrees with the
    live rule confirms it (+ 0.1, 1 at most); one that does not falsifies it,
    and makes none. In runs of equal `to`: a live rule at a run's start takes
    the run's first signature to falsify it; a run leaves a live rule if
    another signature is left. So whether one is live at a run's start depends
    on how many runs of length 1 came since a run that was longer (or the first).
    """
    w = Window.partitionBy("key").orderBy("at")
    changed = signatures.withColumn("new", F.coalesce(F.lag("to").over(w) != F.col("to"), F.lit(True)).cast("int"))
    runs = changed.withColumn("run", F.sum("new").over(w)).withColumn("place", F.row_number().over(Window.partitionBy("key", "run").orderBy("at")))
    g = runs.groupBy("key", "run").agg(F.first("to").alias("to"), F.count("*").alias("length"), F.min(F.when(F.col("place") == 1, F.col("at"))).alias("at1"), F.min(F.when(F.col("place") == 2, F.col("at"))).alias("at2"))
    r = Window.partitionBy("key").orderBy("run")
    sure = F.max(F.when((F.col("length") > 1) | (F.col("run") == 1), F.col("run"))).over(r.rowsBetween(Window.unboundedPreceding, -1))
    g = g.withColumn("live", F.coalesce((F.col("run") - sure) % 2 == 1, F.lit(False)))
    confirmed = F.col("length") - 1 - F.col("live").cast("int")
    last = F.max("run").over(Window.partitionBy("key"))
    out = g.select("key", "run", "to", "live", "length", "at1", "at2", (F.col("run") < last).alias("falsified")).where(~F.col("live") | (F.col("length") > 1))
    return out.select("key", "to", F.when(F.col("live"), F.col("at2")).otherwise(F.col("at1")).alias("created_at"), F.round(F.least(F.lit(1.0), 0.5 + 0.1 * confirmed), 6).alias("confidence"), "falsified")


def transferred(learned: DataFrame, task: str) -> DataFrame:
    """task, other_task and the live rules of other tasks with the same fingerprint. learned: task, fingerprint, to, confidence, falsified."""
    live = learned.where("NOT falsified")
    other = live.select(F.col(task).alias("other_task"), "fingerprint", "to", "confidence")
    return learned.select(task, "fingerprint").distinct().join(other, "fingerprint").where(F.col(task) != F.col("other_task"))


def goal_gate(updates: DataFrame) -> DataFrame:
    """goal, confidence after all updates (goal, at, confidence, progress): it rises only with progress.

    The last update with progress, or the first of all, sets a value; those
    after it can only lower it: the least of them and of that value.
    """
    w = Window.partitionBy("goal").orderBy(F.desc("at"))
    back = updates.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("goal")))
    base = F.min(F.when(F.col("progress"), F.col("rn"))).over(Window.partitionBy("goal"))
    kept = back.withColumn("base", base).where(F.col("base").isNull() | (F.col("rn") <= F.col("base")))
    # Without any progress the first confidence, 0, never rises.
    return kept.groupBy("goal").agg(F.when(F.max("base").isNull(), F.least(F.lit(0.0), F.min("confidence"))).otherwise(F.min("confidence")).alias("confidence"))


def reward_errors(outcomes: DataFrame, by: float) -> DataFrame:
    """outcomes (predicted, actual, ...) with error (6 places) and direction: past `by` either way, else neutral."""
    error = F.round(F.col("actual") - F.col("predicted"), 6)
    return outcomes.withColumn("error", error).withColumn("direction", F.when(error > by, "positive").when(error < -by, "negative").otherwise("neutral"))


def falsified_actions(errors: DataFrame, untested: DataFrame, least: int = 3) -> DataFrame:
    """task, action, falsified, go: no-go where an action failed its prediction so often and the task has untested ones. errors: task, action, direction; untested: task."""
    g = errors.groupBy("task", "action").agg(F.count_if(F.col("direction") == "negative").alias("falsified"))
    other = untested.select("task").distinct().withColumn("other", F.lit(True))
    return g.join(other, "task", "left").select("task", "action", "falsified", (~((F.col("falsified") >= least) & F.coalesce("other", F.lit(False)))).alias("go"))


def transitions(log: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last transition of each key; earlier ones of the same key are overwritten."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at))
    return log.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def causal_paths(first: DataFrame, second: DataFrame, third: DataFrame) -> DataFrame:
    """source, target, paths, confidence of three-edge patterns; a path is as sure as its least sure edge. Each: src, dst, confidence."""
    a, b, c = first.alias("a"), second.alias("b"), third.alias("c")
    joined = a.join(b, F.col("a.dst") == F.col("b.src")).join(c, F.col("b.dst") == F.col("c.src"))
    sure = F.least("a.confidence", "b.confidence", "c.confidence")
    return joined.groupBy(F.col("a.src").alias("source"), F.col("c.dst").alias("target")).agg(F.count("*").alias("paths"), F.max(sure).alias("confidence"))


def regressions(attempts: DataFrame) -> DataFrame:
    """variant, success_rate, regression_rate with 0 where nothing was tried or failed. attempts: variant, failed, regressed (booleans)."""
    g = attempts.groupBy("variant").agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"), F.count_if(F.col("failed") & F.col("regressed")).alias("regressed"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return g.select("variant", rate(F.col("n") - F.col("failed"), F.col("n")).alias("success_rate"), rate(F.col("regressed"), F.col("failed")).alias("regression_rate"))


def helped(baseline: DataFrame, variant: DataFrame) -> DataFrame:
    """task, reason of the tasks where the variant succeeded and the baseline did not, or needed more steps. Both: task, correct, steps."""
    b, v = baseline.alias("b"), variant.alias("v")
    j = b.join(v, "task").where("v.correct AND (NOT b.correct OR v.steps < b.steps)")
    fewer = F.concat(F.lit("fewer steps: "), F.col("b.steps").cast("string"), F.lit(" to "), F.col("v.steps").cast("string"))
    return j.select("task", F.when(~F.col("b.correct"), "baseline failed").otherwise(fewer).alias("reason"))
