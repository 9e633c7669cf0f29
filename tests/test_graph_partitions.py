"""Partitions that grow with the rows of a graph, so that no task's memory does."""

import pytest
from pyspark.sql import functions as F

from mnemospark import storage
from mnemospark.operators import graph


@pytest.mark.parametrize("run", [
    lambda e, m: graph.reach(e, e.select(F.lit(0).alias("node")).limit(1), 3),
    lambda e, m: graph.shared_neighbours(e, 2),
    lambda e, m: graph.cooccurrence(m, least=2),
])
def test_partitions_grow_with_rows(spark, monkeypatch, run):
    edges = spark.range(400).select((F.col("id") % 20).alias("src"), (F.col("id") % 50).alias("dst"))
    members = edges.select(F.col("src").alias("group_id"), F.col("dst").alias("item"))
    want = sorted(map(tuple, run(edges, members).collect()))
    monkeypatch.setattr(storage, "PART_ROWS", 10)
    parts, get = [], storage.partitions
    monkeypatch.setattr(storage, "partitions", lambda s, rows: parts.append(get(s, rows)) or parts[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert sorted(map(tuple, run(edges, members).collect())) == want
    assert max(parts) >= 40 and spark.conf.get("spark.sql.shuffle.partitions") == before
