"""Vector expressions on array<double> columns; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product; null where lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0 or the lengths differ."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size), F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: x / n))


def score_of_distance(distance: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def mean_pool(vectors: DataFrame, by: str, column: str = "v") -> DataFrame:
    """Element-wise mean of the vectors of each group: `by`, centroid (element order kept)."""
    elements = vectors.select(by, F.posexplode(column).alias("pos", "x"))
    means = elements.groupBy(by, "pos").agg(F.avg("x").alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "x")))  # as long as a vector
    return means.groupBy(by).agg(F.transform(ordered, lambda e: e["x"]).alias("centroid"))
