"""Maintenance of nodes: decay, valence, maturity, resurrection, hygiene and knowledge gaps. Frames in, new frames out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.vec import clamp, cosine

#: Candidates of a label in one round of leaders(), at most; Spark ranks so many before it deals rows out by label.
MOST_CANDIDATES = 1000


def decay_and_archive(nodes: DataFrame, rate: Column, days: float, below: float = 0.10) -> DataFrame:
    """strength * rate ** days; rows that fall under `below` are archived, archived ones stay so."""
    faded = nodes.withColumn("strength", F.col("strength") * F.pow(rate, F.lit(days)))
    return faded.withColumn("archived", F.coalesce("archived", F.lit(False)) | (F.col("strength") < below))


def hebbian(strength: Column, days: Column) -> Column:
    """Strength after a use: s + ln(1 + 1 / days), a second at least."""
    return strength + F.log1p(1 / F.greatest(days, F.lit(1 / 86400)))


def valence_decay(nodes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """strength * (1 + 0.3 mean outcome), held in 0..1. outcomes: node_id, valence."""
    mean = outcomes.groupBy("node_id").agg(F.avg("valence").alias("mean_valence"))
    moved = nodes.join(mean, "node_id")
    return moved.withColumn("strength", clamp(F.col("strength") * (1 + 0.3 * F.col("mean_valence")), 0.0, 1.0))


def maturity(procedures: DataFrame) -> DataFrame:
    """Three passes: mature (5 uses, 0.75), developing (3, 0.50), degraded (3, under 0.30: half the strength, archived under 0.20)."""
    n, ok = F.col("uses"), F.col("success_rate")
    stage = F.when((n >= 5) & (ok >= 0.75), "mature").when((n >= 3) & (ok >= 0.50), "developing").when((n >= 3) & (ok < 0.30), "degraded").otherwise("new")
    out = procedures.withColumn("stage", stage)
    weak = F.col("stage") == "degraded"
    out = out.withColumn("strength", F.when(weak, F.col("strength") * 0.5).otherwise(F.col("strength")))
    return out.withColumn("archived", weak & (F.col("strength") < 0.20))


def maturity_alternate(procedures: DataFrame) -> DataFrame:
    """degraded under 0.4 from 3 uses, mature from 10, developing from 3."""
    n, ok = F.col("uses"), F.col("success_rate")
    return procedures.withColumn("stage", F.when((n >= 3) & (ok < 0.4), "degraded").when(n >= 10, "mature").when(n >= 3, "developing").otherwise("new"))


def resurrect(nodes: DataFrame, least: float = 0.85, strength: float = 0.85) -> DataFrame:
    """Archived nodes with a live node of their label at cosine `least` or more come back with `strength`.

    Joined within a label; only archived rows are on one side.
    """
    gone, live = nodes.where("archived").alias("g"), nodes.where("NOT archived").alias("l")
    near = (F.col("g.label") == F.col("l.label")) & (cosine(F.col("g.v"), F.col("l.v")) >= least)
    return gone.join(live, near, "left_semi").withColumn("strength", F.lit(strength)).withColumn("archived", F.lit(False))


def hygiene(nodes: DataFrame, by: str, alert: float) -> DataFrame:
    """by, total, archived rows, their ratio, and whether it calls for a rebuild."""
    g = nodes.groupBy(by).agg(F.count("*").alias("total"), F.count_if("archived").alias("archived_rows"))
    return g.withColumn("ratio", F.col("archived_rows") / F.col("total")).withColumn("alert", F.col("ratio") >= alert)


def knowledge_gaps(lessons: DataFrame, messages: DataFrame, plans: DataFrame) -> DataFrame:
    """domain, gap, severity from three aggregates by domain.

    lessons: domain, lessons, confidence; messages: domain, messages; plans: domain, plans.
    """
    every = lessons.join(messages, "domain", "full").join(plans, "domain", "full")
    n, m, p = (F.coalesce(c, F.lit(0)) for c in ("lessons", "messages", "plans"))
    gap = F.when((n < 2) & (m > 5), "missing_lessons").when((p > 0) & (n == 0), "no_lessons_for_archetype").when((n > 0) & (F.col("confidence") < 0.5), "low_quality")
    raw = F.when(gap == "low_quality", F.least(F.lit(1.0), F.try_divide(m, n * 10.0))).otherwise(F.least(F.lit(1.0), m / 10.0))
    severity = F.when((gap == "no_lessons_for_archetype") & (raw < 0.5), 0.6).otherwise(raw)
    return every.select("domain", gap.alias("gap"), severity.alias("severity")).where("gap IS NOT NULL")


def prune_sessions(edges: DataFrame, sessions: DataFrame, now: Column, days: int) -> DataFrame:
    """Edges (session_id, ...) but those of sessions idle for longer; sessions: session_id, started_at, last_active_at."""
    idle = sessions.where(F.coalesce("last_active_at", "started_at") < now - F.make_dt_interval(F.lit(days))).select("session_id")
    return edges.join(idle, "session_id", "left_anti")


def synthesise(plans: DataFrame, above: float = 0.5, least: int = 2) -> DataFrame:
    """Procedures from good plans of one strategy: strategy, plans, strength min(1, 1.1 max), confidence mean. plans: strategy, valence, strength, confidence."""
    g = plans.where(F.col("valence") > above).groupBy("strategy").agg(F.count("*").alias("plans"), F.least(F.lit(1.0), 1.1 * F.max("strength")).alias("strength"), F.avg("confidence").alias("confidence"))
    return g.where(F.col("plans") >= least)


def rescore(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Confidence from neighbours: + min(0.05 n, 0.30), + 0.10 where their mean strength is over 0.70, at most 0.99; rows that change by 0.02 or more, promoted from 0.90.

    edges: src, dst, undirected; the neighbourhood is one step.
    """
    near = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    strength = nodes.select(F.col("node_id").alias("dst"), F.col("strength").alias("s"))
    agg = near.join(strength, "dst").groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n"), F.avg("s").alias("mean"))
    bonus = F.least(0.05 * F.col("n"), F.lit(0.30)) + F.when(F.col("mean") > 0.70, 0.10).otherwise(0.0)
    new = F.least(F.col("confidence") + bonus, F.lit(0.99))
    out = nodes.join(agg, "node_id").withColumn("new_confidence", new)
    return out.where(F.round(F.col("new_confidence") - F.col("confidence"), 9) >= 0.02).withColumn("promoted", F.col("new_confidence") >= 0.90)


def _first_leaders(pairs):
    """Of one label's pairs (a, b), a <= b, of near candidates: those that no earlier leader is near."""
    import pandas as pd

    near: dict[int, list[int]] = {}
    for a, b in zip(pairs["a"], pairs["b"]):
        near.setdefault(b, []).append(a)
    found: set[int] = set()
    for b in sorted(near):
        if found.isdisjoint(near[b]):
            found.add(b)
    return pd.DataFrame({"label": [pairs["label"].iloc[0]] * len(found), "cluster": sorted(found)})


def leaders(nodes: DataFrame, similar: float, least: int, seeds: int) -> DataFrame:
    """Greedy clusters in each label: the lowest free id is the seed, free nodes at `similar` or more to it are its members.

    Goes on until each label has `seeds` clusters of `least` nodes or more, or
    no free node; a smaller group is given up with all its nodes and does not
    count. A node thus belongs to the earliest leader near it, and a leader is
    a node that no earlier leader is near, so a round settles a block of
    candidates a label (the lowest free ids): the leaders among them, then one
    join of the free nodes with those leaders. Rounds are stored tables. Nodes
    without a label, an id or a vector are in no cluster.
    """
    from mnemospark.storage import cut, shared_root

    path = f"{shared_root(nodes.sparkSession)}/mnemospark/leaders-{uuid.uuid4().hex}"
    kind = nodes.select("label").schema["label"].dataType.simpleString()
    rest = nodes.where("label IS NOT NULL AND node_id IS NOT NULL AND v IS NOT NULL").select("node_id", "label", "v")
    block, found = max(8, 4 * seeds), None
    while found is None or not rest.isEmpty():
        order = F.row_number().over(Window.partitionBy("label").orderBy("node_id"))
        first = cut(rest.withColumn("rn", order).where(F.col("rn") <= block).drop("rn"), "block")
        x, y = first.alias("x"), first.alias("y")
        close = (F.col("x.label") == F.col("y.label")) & ((F.col("x.node_id") == F.col("y.node_id")) | (F.col("x.node_id") < F.col("y.node_id")) & (cosine(F.col("x.v"), F.col("y.v")) >= similar))
        pairs = x.join(y, close).select("x.label", F.col("x.node_id").alias("a"), F.col("y.node_id").alias("b"))
        heads = cut(pairs.groupBy("label").applyInPandas(_first_leaders, f"label {kind}, cluster long"), "heads")
        heads = first.join(heads, (first.label == heads.label) & (first.node_id == heads.cluster)).select(first.label.alias("of"), "cluster", F.col("v").alias("u"))
        joined = rest.join(heads, (F.col("label") == F.col("of")) & ((F.col("node_id") == F.col("cluster")) | (cosine(F.col("v"), F.col("u")) >= similar)))
        near = cut(joined.groupBy("label", "node_id").agg(F.min("cluster").alias("cluster")), "near")
        full = near.groupBy("label", "cluster").agg(F.count("*").alias("size")).where(F.col("size") >= least)
        near.join(full.select("label", "cluster"), ["label", "cluster"], "left_semi").select("node_id", "label", "cluster").write.mode("append").parquet(path)
        found = nodes.sparkSession.read.schema(f"node_id long, label {kind}, cluster long").parquet(path)
        heads = found.select("label", "cluster").distinct()
        done = heads.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= seeds).select("label")
        rest = cut(rest.join(near.select("label", "node_id"), ["label", "node_id"], "left_anti").join(done, "label", "left_anti").select("node_id", "label", "v"), "rest")
        block = min(2 * block, MOST_CANDIDATES)
    rank = F.row_number().over(Window.partitionBy("label").orderBy("cluster"))
    kept = heads.withColumn("rank", rank).where(F.col("rank") <= seeds).select("label", "cluster")
    return found.join(kept, ["label", "cluster"], "left_semi").select("node_id", "label", "cluster")
