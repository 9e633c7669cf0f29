"""Stateful operators on streams of turns: gated consolidation and work summaries.

State is kept for each key in Spark's state store and survives a restart with
the checkpoint; the rows of a trigger are folded in the order of `seq`. The
consolidation is keyed by workspace and concept (or pair of concepts), so a
workspace that holds a third of all turns is dealt out over its concepts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Gate of a concept: below the floor it is noise; an assistant's word is never certain; strong feeling lifts a doubtful one over the floor.
NOISE_FLOOR, CERTAIN, ASSISTANT_CAP = 0.60, 0.90, 0.85
RESCUE_FROM, RESCUE_SALIENCE, RESCUED = 0.45, 1.3, 0.62
FIRST_STRENGTH = 0.5
#: A work summary every turn, a snapshot every so many.
SNAPSHOT_TURNS = 10

TTL_TRIGGER = "10 seconds"
#: transformWithState keeps its state there; a query takes the setting when it starts.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: By default a query that goes by the clock makes a batch each trigger, data or not, and so is never done with what is there.
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def gated(confidence: Column, role: Column, salience: Column) -> Column:
    """The confidence with which a concept enters, null for noise."""
    rescued = F.when((confidence >= RESCUE_FROM) & (confidence < NOISE_FLOOR) & (salience >= RESCUE_SALIENCE), F.lit(RESCUED)).otherwise(confidence)
    passed = F.when(confidence >= NOISE_FLOOR, F.when(role == "assistant", F.least(confidence, F.lit(ASSISTANT_CAP))).otherwise(confidence)).otherwise(rescued)
    return F.when(passed >= NOISE_FLOOR, passed)


def mentions(turns: DataFrame) -> DataFrame:
    """workspace, kind, item, seq, x: each concept of a turn, and each two that follow one another in it.

    turns: workspace, seq, role, salience, concepts (array of structs name,
    confidence, in the order of the text). A concept counts once a turn, where
    it stands first; x is its confidence, for a pair the lower one.
    """
    kept = F.filter(F.transform("concepts", lambda c: F.struct(c["name"].alias("name"), gated(c["confidence"], F.col("role"), F.col("salience")).alias("x"))), lambda c: c["name"].isNotNull() & c["x"].isNotNull())
    once = turns.select("workspace", "seq", kept.alias("all")).withColumn("names", F.transform("all", lambda c: c["name"]))
    once = once.select("workspace", "seq", F.filter("all", lambda c, i: F.array_position("names", c["name"]) == i + 1).alias("c"))
    singles = F.transform("c", lambda c: F.struct(F.lit("concept").alias("kind"), c["name"].alias("item"), c["x"].alias("x")))
    ends = lambda i: (F.get("c", i - 1), F.get("c", i))
    pair = lambda a, b: F.struct(F.lit("pair").alias("kind"), F.concat(F.least(a["name"], b["name"]), F.lit("|"), F.greatest(a["name"], b["name"])).alias("item"), F.least(a["x"], b["x"]).alias("x"))
    pairs = F.filter(F.transform("c", lambda c, i: F.when(i > 0, pair(*ends(i)))), lambda p: p.isNotNull())
    return once.select("workspace", "seq", F.explode(F.concat(singles, F.array_distinct(pairs))).alias("m")).select("workspace", "m.kind", "m.item", "seq", "m.x")


class _Consolidate(StatefulProcessor):
    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "mentions long, strength double, last_seq long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        workspace, kind, item = key
        n, strength, last = self.known.get() if self.known.exists() else (0, 0.0, 0)
        out = []
        for seq, x in sorted((s, x) for batch in rows for s, x in zip(batch.seq.tolist(), batch.x.tolist(), strict=True)):
            n += 1
            if kind == "pair":  # the running mean of a merged edge
                strength = x if n == 1 else (strength + x) / 2
            else:  # what was met lately is strengthened most
                strength = FIRST_STRENGTH if n == 1 else strength + math.log(1 + 1 / max(1, seq - last))
            last = max(last, seq)
            out.append((workspace, kind, item, seq, "created" if n == 1 else "additive", n, strength))
        self.known.update((n, strength, last))
        yield pd.DataFrame(out, columns=["workspace", "kind", "item", "seq", "action", "mentions", "strength"])

    def close(self) -> None:
        pass


def _use_provider(stream: DataFrame) -> None:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _write(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def consolidate(turns: DataFrame, path: str, checkpoint: str, ttl_days: int | None = None) -> StreamingQuery:
    """Every mention that passes the gate, as an event with the state after it: workspace, kind, item, seq, action, mentions, strength.

    A later mention sees what earlier ones wrote, over triggers and restarts.
    Without ttl_days it ends when all that is there has been read. With them an
    item that nothing touched for so long is forgotten; that goes by the clock,
    so the query then runs until it is stopped. Without new turns it makes no
    batch: what has run out is unknown to the next mention, and is dropped from
    the store with the next batch.
    """
    ttl = None if ttl_days is None else ttl_days * 86_400_000
    keyed = mentions(turns).groupBy("workspace", "kind", "item")
    schema = "workspace string, kind string, item string, seq long, action string, mentions long, strength double"
    _use_provider(turns)
    if ttl is None:
        return _write(keyed.transformWithStateInPandas(_Consolidate(None), schema, "Append", "None"), path, checkpoint, availableNow=True)
    conf = turns.sparkSession.conf
    before = conf.get(EMPTY_BATCHES)
    conf.set(EMPTY_BATCHES, "false")  # a query takes the setting when it starts
    try:
        return _write(keyed.transformWithStateInPandas(_Consolidate(ttl), schema, "Append", "ProcessingTime"), path, checkpoint, processingTime=TTL_TRIGGER)
    finally:
        conf.set(EMPTY_BATCHES, before)


class _Summarise(StatefulProcessor):
    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "turns long, tokens long, since long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, tokens, since = self.held.get() if self.held.exists() else (0, 0, None)
        out = []
        for seq, role, k in sorted((s, r, t) for batch in rows for s, r, t in zip(batch.seq.tolist(), batch.role, batch.tokens.tolist(), strict=True)):
            n, tokens, since = n + 1, tokens + k, seq if since is None else since
            out.append((key[0], "line", n, seq, f"turn {n} by {role}", k))
            if n % self.every == 0:
                out.append((key[0], "snapshot", n, seq, f"turns {n - self.every + 1} to {n} since {since}", tokens))
                tokens, since = 0, None
        self.held.update((n, tokens, since))
        yield pd.DataFrame(out, columns=["session_id", "kind", "turns", "seq", "text", "tokens"])

    def close(self) -> None:
        pass


def summarise(turns: DataFrame, path: str, checkpoint: str, every: int = SNAPSHOT_TURNS) -> StreamingQuery:
    """A line each turn and a snapshot each `every` turns of a session: session_id, kind, turns, seq, text, tokens.

    turns: session_id, seq, role, tokens. A snapshot covers the turns since the one before it.
    """
    keyed = turns.select("session_id", "seq", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")).groupBy("session_id")
    _use_provider(turns)
    return _write(keyed.transformWithStateInPandas(_Summarise(every), "session_id string, kind string, turns long, seq long, text string, tokens long", "Append", "None"), path, checkpoint, availableNow=True)


def state_of(events: DataFrame) -> DataFrame:
    """The last state of every item in consolidation events: workspace, kind, item, mentions, strength."""
    return events.groupBy("workspace", "kind", "item").agg(F.max("mentions").alias("mentions"), F.max_by("strength", "mentions").alias("strength"))


def folded(turns: DataFrame) -> DataFrame:
    """The same state from a whole table at once, by windows instead of a replay."""
    m = mentions(turns)
    w = Window.partitionBy("workspace", "kind", "item").orderBy("seq")
    gap = F.greatest(F.lit(1), F.col("seq") - F.lag("seq").over(w))
    placed = m.withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("workspace", "kind", "item"))).withColumn("gain", F.log(1 + 1 / gap))
    half = F.when(F.col("k") == 1, F.pow(F.lit(0.5), F.col("n") - 1)).otherwise(F.pow(F.lit(0.5), F.col("n") - F.col("k") + 1))
    gain = F.when(F.col("kind") == "pair", F.col("x") * half).when(F.col("k") == 1, F.lit(FIRST_STRENGTH)).otherwise(F.col("gain"))
    return placed.groupBy("workspace", "kind", "item").agg(F.count("*").alias("mentions"), F.sum(gain).alias("strength"))
