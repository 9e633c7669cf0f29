"""Sources: files, read-only SQL, chunks; greedy clusters against brute force."""

import numpy as np
import pytest

from mnemospark.operators import lifecycle
from mnemospark.sources import tabular


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,a\n2,\n")
    (tmp_path / "a.tsv").write_text("x\ty\n1\ta\n")
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    frames = {k: tabular.read_table(spark, str(tmp_path / f"a.{k}")) for k in ("csv", "tsv", "json")}
    assert {k: f.count() for k, f in frames.items()} == {"csv": 2, "tsv": 1, "json": 2}
    assert dict(frames["csv"].dtypes)["x"] == "int"
    assert tabular.query(frames["csv"], "SELECT sum(x) AS s FROM data").collect()[0].s == 3
    frames["tsv"].createOrReplaceTempView("data")
    frames["tsv"].createOrReplaceTempView("other")
    assert tabular.query(frames["csv"], "WITH big AS (SELECT * FROM data WHERE x > 1) SELECT count(*) AS n FROM big JOIN data USING (x) WHERE x IN (SELECT x FROM data)").collect()[0].n == 1
    assert spark.table("data").columns == ["x\ty"] or spark.table("data").count() == 1  # the caller's view stays
    for bad in (
        "DROP TABLE data", "WITH a AS (SELECT 1) INSERT INTO other SELECT * FROM a", "SELECT * FROM other", "SELECT * FROM data WHERE x IN (SELECT x FROM other)", f"SELECT * FROM parquet.`{tmp_path}`",
        "SELECT 1) AS t; DROP TABLE data --", "WITH big AS (SELECT * FROM other) SELECT * FROM big", "SELECT * FROM range(3)", "SET a = 1",
    ):
        with pytest.raises(ValueError):
            tabular.query(frames["csv"], bad)
    assert {r.column: r.null_count for r in tabular.profile(frames["csv"]).collect()} == {"x": 0, "y": 1}


def test_chunks():
    long = "One sentence here. " * 300
    text = "# A\n\nshort\n\n" + "p" * 100 + "\n\n" + long + "\n# B\n" + "q" * 2500
    spans = tabular.chunk(text)
    parts = [text[a:b] for a, b in spans]
    assert all(p == p.strip() and 0 < len(p) <= tabular.MAX_CHUNK for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())
    assert parts[0].startswith("# A") and len(parts[0]) >= tabular.MIN_CHUNK
    assert tabular.chunk("") == [] and tabular.chunk(" \n\n ") == []


def test_chunks_of_rows_without_id(spark):
    docs = spark.createDataFrame([(2**60 + 1, "a b"), (None, "c d"), (3, None), (4, " ")], "doc_id long, text string").coalesce(1)
    assert sorted(((r.doc_id, r.text) for r in tabular.chunks(docs).collect()), key=str) == [(2**60 + 1, "a b"), (None, "c d")]


def test_turns_are_shortened_at_a_sentence(spark):
    from pyspark.sql import functions as F

    from mnemospark.streaming.turns import shortened

    texts = ["short", "One. Two three", "word " * 4, "x" * 20, None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(shortened(F.col("t"), 12)).collect()]
    assert got == ["short", "One.", "word word", "x" * 12, None]


def test_composed_texts_have_one_key(spark):
    from pyspark.sql import functions as F

    from mnemospark.functions import text

    rows = [("caf\u00e9  au lait",), ("cafe\u0301 au\nlait ",), ("Caf\u00e9 au lait",)]
    keys = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.dedupe_key("T", F.col("t"), F.lit("s"), F.lit(None).cast("string"))).collect()]
    assert keys[0] == keys[1] != keys[2]


def test_clamped_folds_over_many_chunks(spark, monkeypatch):
    from mnemospark.operators import world

    monkeypatch.setattr(world, "CHUNK", 4)
    rng = np.random.default_rng(8)
    rows = [(k % 3, i, bool(rng.random() < 0.5), float(rng.random() * 3)) for i, k in enumerate(rng.integers(0, 3, 200).tolist())]
    want = {}
    for h, _, up, w in rows:
        c, n, low = want.get(h, (0.5, 0, False))
        c = min(1.0, c + min(0.1, 0.05 * w)) if up else max(0.0, c - min(0.15, 0.1 * w))
        want[h] = (c, n + 1, low or (not up and round(c, 9) < 0.1))
    got = world.hypotheses(spark.createDataFrame(rows, "hypothesis long, at long, confirms boolean, weight double")).collect()
    assert {(r.hypothesis, r.evidence_count, round(r.confidence, 9), r.demoted) for r in got} == {(h, n, round(c, 9), low) for h, (c, n, low) in want.items()}


def test_leaders(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4))
    rows = [(i, i % 2, [float(x) for x in v[i]]) for i in range(60)]
    got = {(r.cluster, r.node_id) for r in lifecycle.leaders(spark.createDataFrame(rows, "node_id long, label int, v array<double>"), 0.6, 3, 3).collect()}
    unit, want = v / np.linalg.norm(v, axis=1)[:, None], set()
    for label in (0, 1):
        rest = [i for i in range(60) if i % 2 == label]
        for _ in range(3):
            seed = rest[0]
            near = [i for i in rest if i == seed or unit[i] @ unit[seed] >= 0.6]
            if len(near) >= 3:
                want |= {(seed, i) for i in near}
                rest = [i for i in rest if i not in near]
            else:
                rest = rest[1:]
    assert got == want


def greedy(v, labels, similar, least, most):
    """The reference's loop: groups under `least` are given up with all their nodes and do not count."""
    unit, want = v / np.linalg.norm(v, axis=1)[:, None], set()
    for label in sorted(set(labels)):
        free, full = [i for i in range(len(v)) if labels[i] == label], 0
        while free and full < most:
            seed = free[0]
            near = [i for i in free if i == seed or unit[i] @ unit[seed] >= similar]
            free = [i for i in free if i not in near]
            if len(near) >= least:
                want |= {(label, seed, i) for i in near}
                full += 1
    return want


@pytest.mark.parametrize("similar,least,most", [(0.6, 3, 2), (0.9, 3, 4), (0.97, 2, 3), (0.6, 1, 100)])
def test_leaders_go_on_past_small_groups(spark, similar, least, most):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 4))
    v[:80] = np.eye(4)[np.arange(80) % 4] * 0.01 + rng.normal(size=(80, 4)) * 10  # hardly any near nodes under the lowest ids
    labels = [0 if i < 200 else i % 3 for i in range(300)]
    rows = [(i, labels[i], [float(x) for x in v[i]]) for i in range(300)] + [(900, None, [1.0, 0.0, 0.0, 0.0]), (901, 0, None)]
    got = lifecycle.leaders(spark.createDataFrame(rows, "node_id long, label int, v array<double>"), similar, least, most).collect()
    assert {(r.label, r.cluster, r.node_id) for r in got} == greedy(v, labels, similar, least, most)
    assert len(got) == len({r.node_id for r in got})


def test_ranked_sources_are_named_for_what_they_read(spark):
    from mnemospark.plans import recall_queries
    from mnemospark.sources.memory_tables import nodes

    found = recall_queries._ranked(nodes(spark, "/root/testdata/sf0.001"))
    assert {r.source for r in found.select("source").distinct().collect()} == {"vector", "strength"}
