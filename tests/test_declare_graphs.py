"""Graphs declared in one pass against all of them declared level by level."""

import random

import pytest

from mnemospark.operators import taskgraph


def _edges(spark, share):
    rng = random.Random(7)
    rows, place = [], 0
    for g in range(6):
        for _ in range(rng.randint(2, 9)):
            place += 1
            a, b = (100 * g + rng.randint(0, 5) for _ in range(2))
            rows.append((g, place, a, b if rng.random() > 0.1 else None))
    if share:
        rows += [(1, place + 1, 101, 201), (2, place + 2, 201, 101), (2, place + 3, 201, 102)]
    return spark.createDataFrame(rows, "graph_id long, place long, src long, dst long")


@pytest.mark.parametrize(("share", "small"), [(False, 20_000), (True, 6)])
def test_one_pass_equals_levels(spark, monkeypatch, share, small):
    monkeypatch.setattr(taskgraph, "SMALL", small)
    edges = _edges(spark, share)
    got = {(r.graph_id, r.place, r.accepted) for r in taskgraph.declare_graphs(edges).collect()}
    want = {(r.graph_id, r.place, r.accepted) for r in taskgraph.declare(edges).select("graph_id", "place", "accepted").collect()}
    assert got == want


def test_small_graphs_take_no_levels(spark, monkeypatch):
    monkeypatch.setattr(taskgraph, "declare", lambda *a: pytest.fail("declared level by level"))
    tasks = spark.createDataFrame([(1, 1, "pending"), (1, 2, "pending")], "graph_id long, task_id long, status string")
    depends = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 2, 1)], "graph_id long, place long, task_id long, on_id long")
    assert sorted((r.place, r.accepted) for r in taskgraph.register(tasks, depends)[1].collect()) == [(1, True), (2, False)]


@pytest.mark.parametrize(("share", "small"), [(False, 20_000), (True, 6)])
def test_asked_pairs_equal_levels(spark, monkeypatch, share, small):
    monkeypatch.setattr(taskgraph, "SMALL", small)
    edges = _edges(spark, share).where("src < dst").select("graph_id", "src", "dst")
    pairs = edges.selectExpr("graph_id", "dst AS src", "src + 1 AS dst").distinct()
    got = {tuple(r) for r in taskgraph.closes_cycle_graphs(edges, pairs).select("graph_id", "src", "dst", "cycle").collect()}
    assert got == {tuple(r) for r in taskgraph.closes_cycle(edges, pairs).select("graph_id", "src", "dst", "cycle").collect()}
