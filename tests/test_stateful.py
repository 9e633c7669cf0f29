"""Consolidation and summaries over several triggers and a restart against folds of the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from mnemospark.streaming import stateful

SCHEMA = "workspace string, seq long, role string, salience double, concepts array<struct<name string, confidence double>>"


def turns(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        concepts = [(rng.choice("abcdef"), rng.choice([0.3, 0.5, 0.7, 0.95])) for _ in range(rng.choice([0, 1, 5]))]
        rows.append((rng.choice(["w", "w", "v", None]), seq, rng.choice(["user", "assistant", None]), rng.choice([1.0, 1.4]), concepts))
    return [*rows, ("w", n, "user", 1.0, None), ("w", n + 1, "user", None, [(None, 0.9), ("a", None), ("b", 0.9)])]


def plain(rows):
    import math

    known = {}
    for ws, seq, role, salience, concepts in sorted(rows, key=lambda r: r[1]):
        kept = []
        for name, c in concepts or []:
            if name is None or c is None:
                continue
            if c >= 0.6:
                c = min(c, 0.85) if role == "assistant" else c
            elif c >= 0.45 and (salience or 0) >= 1.3:
                c = 0.62
            if c >= 0.6 and name not in [k for k, _ in kept]:
                kept.append((name, c))
        items = [("concept", n, c) for n, c in kept]
        pairs = [("pair", "|".join(sorted((a[0], b[0]))), min(a[1], b[1])) for a, b in zip(kept, kept[1:])]
        for kind, item, x in items + sorted(set(pairs)):
            n, s, last = known.get((ws, kind, item), (0, 0.0, 0))
            n += 1
            s = (x if n == 1 else (s + x) / 2) if kind == "pair" else (0.5 if n == 1 else s + math.log(1 + 1 / max(1, seq - last)))
            known[ws, kind, item] = (n, s, seq)
    return {k: (n, round(s, 9)) for k, (n, s, _) in known.items()}


def state(df):
    return {(r.workspace, r.kind, r.item): (r.mentions, round(r.strength, 9)) for r in df.collect()}


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # a state store each
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_consolidation_over_triggers_and_a_restart(spark, tmp_path):
    rows = turns()
    source, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    for k, part in enumerate((rows[:20], rows[20:45], rows[45:])):  # the second and third come after a stop
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        assert stateful.consolidate(stream, out, checkpoint).awaitTermination(120), k
    events = spark.read.parquet(out)
    assert state(stateful.state_of(events)) == plain(rows)
    assert state(stateful.folded(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    assert events.where("action = 'created'").count() == len(plain(rows))


def test_consolidation_that_forgets_runs_until_stopped(spark, tmp_path):
    rows = turns(4, 20)
    source, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(source)
    query = stateful.consolidate(spark.readStream.schema(SCHEMA).parquet(source), out, checkpoint, ttl_days=30)
    try:
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    assert state(stateful.state_of(spark.read.parquet(out))) == plain(rows)


def test_what_has_run_out_is_unknown_to_the_next_mention(spark, tmp_path, monkeypatch):
    """The store forgets after a second; triggers are 10 seconds apart, and those without new turns make no batch."""
    consolidator, empty = stateful._Consolidate, spark.conf.get(stateful.EMPTY_BATCHES)
    monkeypatch.setattr(stateful, "_Consolidate", lambda ttl: consolidator(1000))
    source, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    one = spark.createDataFrame([("w", 1, "user", 1.0, [("a", 0.9)])], SCHEMA).coalesce(1)
    one.write.parquet(source)
    query = stateful.consolidate(spark.readStream.schema(SCHEMA).parquet(source), out, checkpoint, ttl_days=30)
    try:
        query.processAllAvailable()
        one.withColumn("seq", F.lit(2).cast("long")).write.mode("append").parquet(source)
        query.processAllAvailable()
        batches = {p["batchId"] for p in query.recentProgress if p["numInputRows"]}
    finally:
        query.stop()
    assert {(r.seq, r.action, r.mentions) for r in spark.read.parquet(out).collect()} == {(1, "created", 1), (2, "created", 1)}
    assert batches == {0, 1} and spark.conf.get(stateful.EMPTY_BATCHES) == empty


def test_summaries(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("stu"), seq, rng.choice(["user", None]), rng.randrange(9)) for seq in range(50)]
    schema = "session_id string, seq long, role string, tokens long"
    source, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    for part in (rows[:17], rows[17:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        assert stateful.summarise(spark.readStream.schema(schema).parquet(source), out, checkpoint, every=4).awaitTermination(120)
    want, held = set(), {}
    for s, seq, role, tokens in rows:
        own = held.setdefault(s, [])
        own.append((seq, tokens))
        n = len(own)
        want.add((s, "line", n, seq, f"turn {n} by {role or 'unknown'}", tokens))
        if n % 4 == 0:
            want.add((s, "snapshot", n, seq, f"turns {n - 3} to {n} since {own[-4][0]}", sum(t for _, t in own[-4:])))
    assert {tuple(r) for r in spark.read.parquet(out).select("session_id", "kind", "turns", "seq", "text", "tokens").collect()} == want
    assert spark.read.parquet(out).groupBy("session_id", "kind", "turns").count().where(F.col("count") > 1).isEmpty()
