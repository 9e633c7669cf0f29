"""Queries that replay the driver's turns through stateful streams and tailed files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.sources import tail, transcripts
from mnemospark.sources.memory_tables import table
from mnemospark.sources.versioned import Tables
from mnemospark.storage import shared_path
from mnemospark.streaming import stateful


def _stored(df: DataFrame, name: str, by: str) -> DataFrame:
    """df as a stream over four parts in the order of `by`, written one after the other (files are read by their age), a trigger each."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    cuts = [float("-inf"), *df.approxQuantile(by, [0.25, 0.5, 0.75], 0.05), float("inf")]
    for low, high in zip(cuts, cuts[1:]):
        df.where((F.col(by) > low) & (F.col(by) <= high)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def stream_consolidated(spark, sf_dir):
    """What the long words of all turns leave in ten workspaces, after a replay in triggers."""
    t = table(spark, sf_dir, "conversations")
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 12)
    concepts = F.transform(words, lambda w: F.struct(w.alias("name"), (F.lit(0.4) + F.length(w) % 7 / 10).alias("confidence")))
    salience = F.when(F.col("turn") % 3 == 0, 1.5).otherwise(1.0)
    turns = t.select((F.col("conv_id") % 10).cast("string").alias("workspace"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), "role", salience.alias("salience"), concepts.alias("concepts"))
    out = shared_path(spark, "consolidated")
    stateful.consolidate(_stored(turns, "consolidated-in", "seq"), out, shared_path(spark, "consolidated-checkpoint")).awaitTermination()
    return stateful.state_of(spark.read.parquet(out)).withColumn("strength", F.round("strength", 6))


def stream_summaries(spark, sf_dir):
    """Lines and snapshots of every ten turns of twenty sessions, after a replay in triggers."""
    t = table(spark, sf_dir, "conversations")
    turns = t.select((F.col("conv_id") % 20).cast("string").alias("session_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), "role", F.floor(F.length("text") / 3).alias("tokens"))
    out = shared_path(spark, "summaries")
    stateful.summarise(_stored(turns, "summaries-in", "seq"), out, shared_path(spark, "summaries-checkpoint")).awaitTermination()
    return spark.read.parquet(out)


def tail_turns(spark, sf_dir):
    """Conversations as chat exports, a file for each of eight, tailed in two halves: each turn once."""
    t = table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')")
    said = F.when(F.col("role") == "user", F.to_json(F.struct(F.struct(F.struct(F.col("text").alias("text")).alias("message"), F.concat_ws("-", "conv_id", "turn").alias("requestId")).alias("q"))))
    answer = F.to_json(F.struct(F.struct(F.struct(F.lit("").alias("text")).alias("message"), F.concat_ws("-", "conv_id", "turn").alias("requestId"), F.array(F.struct(F.col("text").alias("value"))).alias("response")).alias("q")))
    request = F.get_json_object(F.coalesce(said, answer), "$.q")
    line = F.concat(F.lit('{"v":['), request, F.lit("]}"))
    folder, store = shared_path(spark, "chats"), Tables(spark, shared_path(spark, "chat-state"))
    place = Window.partitionBy(F.col("conv_id") % 8).orderBy("conv_id", "turn")
    lines = t.select(line.alias("value"), (F.col("conv_id") % 8).alias("file"), F.row_number().over(place).alias("n"))
    for half in (0, 1):
        lines.where(F.col("n") % 2 == half).select("value", "file").repartition(8, "file").write.mode("append").partitionBy("file").text(folder)
        tail.drain(spark, folder, store, most=100_000, backfill=None, pattern="*.txt")
        tail.drain(spark, folder, store, most=100_000, backfill=None, pattern="*.txt")
    raw = store.read("lines").select("path", "at", "value")
    turns = transcripts.chat_turns(raw)
    return turns.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"), F.sum(F.length("content")).alias("chars"))


QUERIES = {f.__name__: f for f in (stream_consolidated, stream_summaries, tail_turns)}

ORACLE_SQL = {
    "stream_consolidated": r"""WITH t AS (SELECT CAST(conv_id % 10 AS VARCHAR) AS workspace, conv_id * 100 + turn AS seq, role, CASE WHEN turn % 3 = 0 THEN 1.5 ELSE 1.0 END AS salience,
  list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda w: length(w) >= 12) AS ws FROM conversations
), u AS (SELECT workspace, seq, role, salience, unnest(ws) AS item, unnest(range(len(ws))) AS i FROM t
), g AS (SELECT *, 0.4::DOUBLE + (length(item) % 7)::DOUBLE / 10 AS c FROM u
), x AS (SELECT workspace, seq, item, i, CASE WHEN c >= 0.6 THEN CASE WHEN role = 'assistant' THEN least(c, 0.85) ELSE c END WHEN c >= 0.45 AND salience >= 1.3 THEN 0.62 END AS x FROM g
), f AS (SELECT * FROM x WHERE x >= 0.6 QUALIFY row_number() OVER (PARTITION BY workspace, seq, item ORDER BY i) = 1
), p AS (SELECT workspace, seq, item, x, lag(item) OVER w AS b, lag(x) OVER w AS bx FROM f WINDOW w AS (PARTITION BY workspace, seq ORDER BY i)
), m AS (SELECT workspace, 'concept' AS kind, item, seq, x FROM f UNION ALL SELECT DISTINCT workspace, 'pair', least(item, b) || '|' || greatest(item, b), seq, least(x, bx) FROM p WHERE b IS NOT NULL
), k AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY workspace, kind, item) AS n, ln(1 + 1 / greatest(1, seq - lag(seq) OVER w)::DOUBLE) AS gain FROM m WINDOW w AS (PARTITION BY workspace, kind, item ORDER BY seq))
SELECT workspace, kind, item, count(*) AS mentions, round(sum(CASE WHEN kind = 'pair' THEN x * CASE WHEN k = 1 THEN pow(0.5, n - 1) ELSE pow(0.5, n - k + 1) END WHEN k = 1 THEN 0.5 ELSE gain END), 6) AS strength FROM k GROUP BY ALL""",
    "stream_summaries": """WITH t AS (SELECT CAST(conv_id % 20 AS VARCHAR) AS session_id, conv_id * 100 + turn AS seq, role, length(text) // 3 AS tokens FROM conversations
), n AS (SELECT *, row_number() OVER w AS turns, sum(tokens) OVER (w ROWS 9 PRECEDING) AS ten, first_value(seq) OVER (w ROWS 9 PRECEDING) AS since FROM t WINDOW w AS (PARTITION BY session_id ORDER BY seq))
SELECT session_id, 'line' AS kind, turns, seq, 'turn ' || turns || ' by ' || role AS text, CAST(tokens AS BIGINT) AS tokens FROM n
UNION ALL SELECT session_id, 'snapshot', turns, seq, 'turns ' || (turns - 9) || ' to ' || turns || ' since ' || since, CAST(ten AS BIGINT) FROM n WHERE turns % 10 = 0""",
    "tail_turns": r"""SELECT role, count(*) AS n, count(*) AS events, CAST(sum(length(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS BIGINT) AS chars FROM conversations
WHERE role IN ('user', 'assistant') AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> '' GROUP BY role""",
}
