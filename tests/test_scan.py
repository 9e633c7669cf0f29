"""Blocked scans against scoring every pair in the JVM."""

import random

from pyspark.sql import functions as F

from mnemospark.functions.vec import cosine
from mnemospark.operators import recall, scan


def _nodes(spark, n=700):
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(40)]
    rows = [(i, i % 3 if i % 10 else None, base[i % 40] if i % 4 else [x + rng.gauss(0, 1e-3) for x in base[i % 40]]) for i in range(n)]
    rows += [(n, 1, None), (n + 1, 1, [0.0] * 6), (n + 2, 1, [1.0, 2.0]), (n + 3, 2, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    return spark.createDataFrame(rows, "node_id long, label int, v array<double>")


def _every(nodes, queries):
    return nodes.crossJoin(queries).withColumn("score", cosine(F.col("v"), F.col("q"))).drop("v", "q")


def _bag(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_scans_equal_every_pair(spark, monkeypatch):
    monkeypatch.setattr(scan, "ROWS", 100)
    n = _nodes(spark)
    q = n.where("node_id % 50 = 0").select(F.col("node_id").alias("query_id"), F.col("v").alias("q"))
    every = _every(n, q).cache()
    assert _bag(recall.floor_scan_all(n, q, 0.2)) == _bag(every.where("query_id <> 700 AND score > 0.2").select("query_id", "node_id", "score"))
    top = "row_number() OVER (PARTITION BY query_id {} ORDER BY {} DESC, node_id)"
    want = every.where("query_id <> 700").withColumn("rank", F.expr(top.format("", "score"))).where("rank <= 5").select("query_id", "node_id", "score")
    assert _bag(recall.knn_all(n.withColumn("archived", F.lit(False)), q, 5)) == _bag(want)
    by = every.where("query_id <> 700").withColumn("rank", F.expr(top.format(", label", "round(score, 6)"))).where("rank <= 2").select("query_id", "node_id", "label")
    found = scan.scan(n, q.where("q IS NOT NULL"), k=2, by=("label",)).withColumn("rank", F.expr(top.format(", label", "round(score, 6)"))).where("rank <= 2")
    assert _bag(found.select("query_id", "node_id", "label")) == _bag(by)


def test_blocks_hand_on_few_of_many_copies(spark):
    copies = spark.range(3000).select(F.col("id").alias("node_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    q = copies.where("node_id < 2").select(F.col("node_id").alias("query_id"), F.col("v").alias("q"))
    found = scan.scan(copies, q, k=3)
    assert found.count() <= 2 * 3 * 12
    assert [r.node_id for r in found.where("query_id = 1").orderBy("node_id").limit(3).collect()] == [0, 1, 2]


def test_classes_meet_in_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(scan, "ROWS", 50)
    n = _nodes(spark, 300)
    q = n.select(F.col("node_id").alias("query_id"), F.col("label").alias("own"), F.col("v").alias("q"))
    want = _every(n, q).where("label = own AND query_id < node_id AND score >= 0.5").select("query_id", "node_id", "score")
    found = scan.scan(n, q.withColumnRenamed("own", "label"), least=0.5, within="label", ordered=True)
    assert _bag(found.select("query_id", "node_id", "score")) == _bag(want)
