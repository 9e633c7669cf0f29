"""Views of the driver's tables as a memory graph: messages, nodes with embeddings, edges, provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.storage import partitions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """message_id, session_id, turn, role, text."""
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 10000 + F.col("turn")).alias("message_id"), F.col("conv_id").alias("session_id"), "turn", "role", "text"
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, label, v, strength, confidence, archived."""
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        vec.alias("node_id"), "label", F.col("embedding").cast("array<double>").alias("v"),
        ((vec % 50) / 10.0).alias("strength"), ((vec * 7 % 100) / 100.0).alias("confidence"), (vec % 11 == 0).alias("archived"),
    )


#: The same in DuckDB.
NODES_SQL = """nodes AS (
  SELECT vec_id AS node_id, label, CAST(embedding AS DOUBLE[]) AS v, (vec_id % 50) / 10.0 AS strength,
         (vec_id * 7 % 100) / 100.0 AS confidence, vec_id % 11 = 0 AS archived FROM embeddings)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, rel_type, confidence of the typed graph region > nation > customer > order > part > supplier."""

    def made(frame: DataFrame, a: str, src: str, b: str, dst: str, rel: str, confidence) -> DataFrame:
        return frame.select(F.concat(F.lit(a), F.col(src).cast("string")).alias("src"), F.concat(F.lit(b), F.col(dst).cast("string")).alias("dst"), F.lit(rel).alias("rel_type"), confidence.cast("double").alias("confidence"))

    none = F.lit(None)
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    # Lines are many: what one task has to make distinct stays bounded.
    n = partitions(spark, lines.count())
    parts = [
        made(table(spark, sf_dir, "nation"), "r", "n_regionkey", "n", "n_nationkey", "CONTAINS", none),
        made(table(spark, sf_dir, "customer"), "n", "c_nationkey", "c", "c_custkey", "CONTAINS", none),
        made(orders, "c", "o_custkey", "o", "o_orderkey", "INVOKES", F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderkey") % 10 / 10.0)),
        made(lines.select("l_orderkey", "l_partkey").repartition(n, "l_orderkey", "l_partkey").distinct(), "o", "l_orderkey", "p", "l_partkey", "REQUIRES", F.lit(0.5)),
        made(lines.select("l_partkey", "l_suppkey").repartition(n, "l_partkey", "l_suppkey").distinct(), "p", "l_partkey", "s", "l_suppkey", "REQUIRES", F.lit(0.75)),
    ]
    return reduce(DataFrame.unionByName, parts)


EDGES_SQL = """edges AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'CONTAINS' AS rel_type, CAST(NULL AS DOUBLE) AS confidence FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'CONTAINS', NULL FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'INVOKES', CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey % 10 / 10.0 END FROM orders
  UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 'REQUIRES', 0.5 FROM lineitem
  UNION ALL SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey, 'REQUIRES', 0.75 FROM lineitem)"""
