"""Pairs of all items of a group, large groups included."""

from collections import Counter
from itertools import combinations

import duckdb
import pytest

from mnemospark.operators import graph
from mnemospark.plans import graph_queries


def test_an_order_of_many_parts_has_all_its_pairs(spark, tmp_path):
    lines = [(order, part) for order in (1, 2) for part in range(12)] + [(3, 0), (3, 1), (3, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, graph_queries.graph_cooccurrence(spark, str(tmp_path)).select("a", "b", "n").collect()))
    assert got == sorted((a, b, 2 + ((a, b) == (0, 1))) for a, b in combinations(range(12), 2))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(con.execute(graph_queries.ORACLE_SQL["graph_cooccurrence"]).fetchall())


@pytest.mark.parametrize("block", [7, 1000])
def test_blocks_of_a_large_group_meet_once(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK", block)
    groups = {1: range(60), 2: range(30, 45), 3: range(5), 4: [9], None: range(20)}
    members = spark.createDataFrame([(g, i) for g, items in groups.items() for i in items], "group_id long, item long")
    want = Counter(p for g, items in groups.items() if g is not None for p in combinations(items, 2))
    assert {(r.a, r.b): r.n for r in graph.cooccurrence(members, None).collect()} == want


def test_no_members(spark):
    assert graph.cooccurrence(spark.createDataFrame([], "group_id long, item long"), None).count() == 0
