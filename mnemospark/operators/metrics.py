"""Evaluation figures as aggregates."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.vec import clamp


def priors(rows: DataFrame, by: str) -> DataFrame:
    """by, evidence_count, mean and median of progress held in 0..1, to 4 places."""
    p = clamp(F.col("progress"), 0.0, 1.0)
    return rows.where("progress IS NOT NULL").groupBy(by).agg(F.count("*").alias("evidence_count"), F.round(F.avg(p), 4).alias("mean"), F.round(F.median(p), 4).alias("median"))


def rates(results: DataFrame, by: str) -> DataFrame:
    """by, tasks, solve_rate, error_rate, constraint_consistency (1 - violations / max(1, floor(1.5 depth)), 0 at least), chain_depth of the solved. results: solved, error, violations, depth."""
    consistency = F.greatest(F.lit(0.0), 1 - F.sum("violations") / F.sum(F.greatest(F.lit(1), F.floor(F.col("depth") * 1.5))))
    return results.groupBy(by).agg(
        F.count("*").alias("tasks"), F.round(F.avg(F.col("solved").cast("int")), 4).alias("solve_rate"), F.round(F.avg(F.col("error").cast("int")), 4).alias("error_rate"),
        F.round(consistency, 4).alias("constraint_consistency"), F.round(F.coalesce(F.avg(F.when(F.col("solved"), F.col("depth"))), F.lit(0.0)), 4).alias("chain_depth"),
    )


def two_sided(z: Column) -> Column:
    """The two-sided p of a normal z; SQL has no error function, so an Arrow-batched one is used."""

    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)))

    return p(z)


def z_test(results: DataFrame, a: str, b: str) -> DataFrame:
    """One row: pooled z of two variants' failure rates. results: variant, failed (boolean)."""
    n = [F.count_if(F.col("variant") == v).cast("double").alias(f"n{k}") for k, v in enumerate((a, b))]
    x = [F.count_if((F.col("variant") == v) & F.col("failed")).cast("double").alias(f"x{k}") for k, v in enumerate((a, b))]
    g = results.agg(*n, *x)
    pool = F.try_divide(F.col("x0") + F.col("x1"), F.col("n0") + F.col("n1"))
    error = F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), F.col("n0")) + F.try_divide(F.lit(1.0), F.col("n1"))))
    z = F.coalesce(F.try_divide(F.try_divide("x0", "n0") - F.try_divide("x1", "n1"), error), F.lit(0.0))
    return g.select(z.alias("z"))


def percent_change(base: Column, new: Column) -> Column:
    """The change in percent as text; from zero it is +inf, -inf or +0.0%, without either N/A."""
    change = F.try_divide((new - base) * 100, F.abs(base))
    text = F.when(base.isNull() | new.isNull(), "N/A").when((base == 0) & (new == 0), "+0.0%").when(base == 0, F.when(new > 0, "+inf").otherwise("-inf"))
    return text.otherwise(F.format_string("%+.1f%%", F.bround(change, 1)))  # ties to even


def running_overlap(tasks: DataFrame) -> DataFrame:
    """stream, position, recall: the part of a task's constraints that earlier tasks of its stream had. tasks: stream, position, constraint_id.

    A constraint is known from its first position on, so no set is carried along.
    """
    first = F.min("position").over(Window.partitionBy("stream", "constraint_id"))
    once = tasks.distinct().withColumn("known", first < F.col("position"))
    return once.groupBy("stream", "position").agg(F.avg(F.col("known").cast("int")).alias("recall"))
