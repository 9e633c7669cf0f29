"""Patterns over recurring items: regular intervals, rising use, steps before failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def regular(series: DataFrame, max_cv: float = 0.30, instances: int = 3) -> DataFrame:
    """Items whose gaps vary little: key, n, mean_gap, cv (population deviation over mean). series: key, at (seconds)."""
    w = Window.partitionBy("key").orderBy("at")
    gaps = series.withColumn("gap", F.col("at") - F.lag("at").over(w))
    g = gaps.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("gap") > 0).alias("n_gaps"), F.avg(F.when(F.col("gap") > 0, F.col("gap"))).alias("mean_gap"), F.stddev_pop(F.when(F.col("gap") > 0, F.col("gap"))).alias("sd"))
    kept = g.where((F.col("n") >= instances) & (F.col("n_gaps") >= 2)).withColumn("cv", F.try_divide("sd", "mean_gap"))
    return kept.where(F.col("cv") <= max_cv).select("key", "n", "mean_gap", "cv")


def rising(counts: DataFrame, least: int = 4) -> DataFrame:
    """Items used more and more (a slope over rounding noise): key, n, slope (least squares over the session's ordinal), last, mean. counts: key, started_at, n_messages."""
    w = Window.partitionBy("key").orderBy("started_at")
    x = counts.withColumn("ordinal", (F.row_number().over(w) - 1).cast("double"))
    y = F.col("n_messages").cast("double")
    g = x.groupBy("key").agg(F.count("*").alias("n"), F.regr_slope(y, F.col("ordinal")).alias("slope"), F.max_by("n_messages", "ordinal").alias("last"), F.avg(y).alias("mean"))
    return g.where((F.col("n") >= least) & (F.round("slope", 9) > 0) & (F.col("last") > F.col("mean")))


def before_failures(steps: DataFrame, least: int) -> DataFrame:
    """Pairs of steps that come before failed ones: first, second, failed, n. steps: plan, at, kind, failed (boolean)."""
    w = Window.partitionBy("plan").orderBy("at")
    chains = steps.select(F.lag("kind", 2).over(w).alias("first"), F.lag("kind", 1).over(w).alias("second"), F.col("kind").alias("failed_kind"), "failed")
    chains = chains.where("failed AND first IS NOT NULL")
    return chains.groupBy("first", "second", F.col("failed_kind").alias("failed")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def unregistered(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates (trigger) that are not empty and not registered already."""
    return candidates.where(F.trim("trigger") != "").join(known.select("trigger").distinct(), "trigger", "left_anti")
