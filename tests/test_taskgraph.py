"""Declared dependencies, paths and card context against sequential versions."""

import random

import pytest

from mnemospark.operators import taskgraph


def way(edges, a, b):
    """The fewest steps from a to b, level by level, smallest predecessors first."""
    level, paths = [a], {a: [a]}
    while level and b not in paths:
        parents = {}
        for x in level:
            for y in edges.get(x, ()):
                if y not in paths and (y not in parents or x < parents[y]):
                    parents[y] = x
        for y, x in parents.items():
            paths[y] = paths[x] + [y]
        level = list(parents)
    return paths.get(b)


def declared(rows, existing=()):
    edges, out = {}, []
    for a, b in existing:
        edges.setdefault(a, set()).add(b)
    for place, a, b in sorted(rows):
        path = None if a is None or b is None else [a, a] if a == b else way(edges, b, a)
        ok = a is not None and b is not None and path is None
        if ok:
            edges.setdefault(a, set()).add(b)
        out.append((place, ok, None if ok or path is None else path if a == b else [a, *path]))
    return out


@pytest.mark.parametrize(("seed", "nodes", "n"), [(1, 6, 30), (2, 12, 60), (3, 40, 60), (4, 3, 12)])
def test_declared_in_order(spark, seed, nodes, n):
    rng = random.Random(seed)
    rows = [(10 * i, rng.randrange(nodes), rng.randrange(nodes)) for i in range(n)] + [(5, None, 1), (15, 1, None)]
    existing = [(0, 1), (1, 2)] if seed == 2 else []
    proposed = spark.createDataFrame([(*r, "x", True) for r in rows], "place long, src int, dst int, note string, sure boolean")
    had = spark.createDataFrame(existing, "src int, dst int") if existing else None
    got = taskgraph.declare(proposed, had)
    want = declared(rows, existing)
    assert {r.place: r.accepted for r in got.collect()} == {p: ok for p, ok, _ in want}
    if not existing:
        paths = taskgraph.closing_paths(got.where("NOT accepted AND src IS NOT NULL AND dst IS NOT NULL"), got.where("accepted"))
        assert {r.place: r.path for r in paths.collect()} == {p: path for p, _, path in want if path}


def test_no_proposals(spark):
    assert taskgraph.declare(spark.createDataFrame([], "place long, src string, dst string")).count() == 0


def test_cycles_over_any_number_of_edges(spark):
    edges = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(13)]
    pairs = [("n13", "n00"), ("n00", "n13"), ("n05", "n05"), ("x", "y"), ("n12", "n03"), ("n13", "n00")]
    got = taskgraph.closes_cycle(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(pairs, "src string, dst string"))
    assert sorted((r.src, r.dst, r.cycle) for r in got.collect()) == sorted([("n13", "n00", True), ("n00", "n13", False), ("n05", "n05", True), ("x", "y", False), ("n12", "n03", True), ("n13", "n00", True)])


def test_card_context(spark):
    rng = random.Random(7)
    edges = [(f"e{i:03d}", rng.randrange(15), rng.randrange(15), rng.choice(["A", "B"])) for i in range(60)]
    got = taskgraph.card_context(spark.createDataFrame([(c,) for c in range(15)], "card int"), spark.createDataFrame(edges, "edge_id string, src int, dst int, rel_type string"), 3, 2)
    out = set()
    for card in range(15):
        level, seen, listed = {card}, {card}, {}
        for hop in (1, 2, 3):
            met = {}
            for node in level:
                for rel in "AB":
                    for direction, end, other in (("out", 1, 2), ("in", 2, 1)):
                        for e in sorted(e for e in edges if e[end] == node and e[3] == rel)[:2]:
                            if e[0] not in listed:
                                met.setdefault(e[0], []).append((direction, node, e[other]))
            for x, ways in met.items():
                listed[x] = (hop, min(ways)[0])
            level = {o for ways in met.values() for *_, o in ways} - seen
            seen |= level
        out |= {(card, x, *v) for x, v in listed.items()}
    assert {(r.card, r.edge_id, r.hop, r.direction) for r in got.collect()} == out


@pytest.mark.parametrize("small", [20_000, 3])
def test_card_context_of_graphs(spark, monkeypatch, small):
    """Graphs that are alone go in one pass, a shared or large one hop by hop; both as card_context() has it."""
    monkeypatch.setattr(taskgraph, "SMALL", small)
    rng = random.Random(3)
    edges = [(i % 4, f"e{i:03d}", (i % 4) * 10 + rng.randrange(8), (i % 4) * 10 + rng.randrange(8), rng.choice(["A", "B"])) for i in range(80)] + [(4, "x", 50, 0, "A")]
    e = spark.createDataFrame(edges, "graph_id int, edge_id string, src int, dst int, rel_type string")
    cards = spark.createDataFrame([(g, g * 10 + i) for g in range(4) for i in range(8)] + [(4, 50), (5, 60)], "graph_id int, card int")
    got, want = taskgraph.card_context_graphs(cards, e, 3, 2), taskgraph.card_context(cards.select("card"), e.drop("graph_id"), 3, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
