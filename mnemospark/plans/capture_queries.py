"""Queries of captured transcripts, activity lines and run artifacts, with their SQL. The lines are written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.sources import tabular, transcripts
from mnemospark.sources.memory_tables import table
from mnemospark.storage import shared_path


def _written(spark, frame, name, *parts):
    """frame's column `line` as text files, one folder for each value of `parts`, read back."""
    path = shared_path(spark, name)
    frame.select("line", *parts).write.partitionBy(*parts).text(path) if parts else frame.select("line").write.text(path)
    return transcripts.lines(spark, path)


def _conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumn("body", F.concat(F.lit(" "), F.coalesce("text", F.lit(""))))


def capture_messages(spark, sf_dir):
    """One message a line: texts and lists of parts, some meta rows and tool results, some lines cut off."""
    c = _conversations(spark, sf_dir)
    n = F.col("conv_id") * 3 + F.col("turn")
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    ids = [F.concat_ws("-", "conv_id", "turn").alias("uuid"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("sessionId"), F.lit("/work").alias("cwd"), F.col("turn").cast("string").alias("timestamp"), F.col("role").alias("type")]
    text = F.to_json(F.struct(*ids, F.when(n % 5 == 0, True).alias("isMeta"), F.struct("role", F.col("body").alias("content")).alias("message")))
    parts = F.array(part("thinking", F.lit("hm")), part("text", F.col("body")), part("tool_result", F.lit("42")), part("text", F.lit("done")))
    listed = F.to_json(F.struct(*ids, F.when(n % 7 == 0, "out").alias("toolUseResult"), F.struct("role", parts.alias("content")).alias("message")))
    line = F.when(n % 11 == 0, F.concat(F.lit("{"), text)).when(n % 2 == 0, text).otherwise(listed)
    turns = transcripts.message_turns(_written(spark, c.select(line.alias("line")), "messages"))
    return turns.select("session_id", F.col("timestamp").cast("long").alias("turn"), "role", F.col("content_hash").alias("content_sha256"), "repo_root")


def capture_events(spark, sf_dir):
    """One event a line; a file holds conversations one after the other, each after a line that names its session."""
    c = _conversations(spark, sf_dir)
    stamp = F.col("turn").cast("string").alias("timestamp")
    said = F.struct(F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "agent_message").otherwise("note").alias("type"), F.col("body").alias("message"))
    event = F.to_json(F.struct(F.lit("event_msg").alias("type"), stamp, said.alias("payload")))
    meta = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("id"), F.lit("/work").alias("cwd")).alias("payload")))
    rows = c.select("conv_id", F.col("turn"), event.alias("line")).union(c.select("conv_id").distinct().select("conv_id", F.lit(-1), meta))
    filed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    turns = transcripts.event_turns(_written(spark, filed, "events"))
    return turns.select("session_id", F.col("timestamp").cast("long").alias("turn"), "role", F.col("content_hash").alias("content_sha256"))


_METHODS = [*transcripts.WRITES[:3], *transcripts.RECALLS[:2], "recall_plans", *transcripts.STATUS, "forget"]


def _method():
    return F.element_at(F.array(*map(F.lit, _METHODS)), (F.col("event_id") % len(_METHODS) + 1).cast("int"))


def activity_lanes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", transcripts.lane(_method()).alias("lane"))
    return e.groupBy("user_id", "lane").agg(F.count("*").alias("n"))


def activity_recent(spark, sf_dir):
    """The last forty lines of each log; every seventh line is cut off."""
    e = table(spark, sf_dir, "events").withColumn("log", F.col("user_id") % 16)
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("ts"), F.col("event_type").alias("event"), _method().alias("method")))
    log = e.select(F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("#"), F.col("event_id").cast("string"))).otherwise(line).alias("line"), "event_id", "log").repartition("log").sortWithinPartitions("log", "event_id")
    last = transcripts.recent(_written(spark, log, "activity", "log"), 40)
    return last.select(F.regexp_extract("path", r"log=(\d+)", 1).cast("long").alias("log"), "back", "ts", "event", "method", "line")


def _artifacts(spark, sf_dir, having):
    """A run per order: an object with tasks (lines) in a list, each with nested steps."""
    x = table(spark, sf_dir, "lineitem")
    inner = F.struct(F.lit("world_model_step").alias("kind"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("task_id"), F.col("l_linenumber").alias("step"), F.struct(F.col("l_suppkey").alias("node_count"), F.col("l_returnflag").alias("action_effect_class"), (F.col("l_quantity") > 40).alias("single_action_stall_detected")).alias("data"))
    task = F.struct(F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("task_id"), F.when(F.col("l_returnflag") == "N", "solved").when(F.col("l_returnflag") == "R", "lost").alias("status"), F.when(F.col("l_quantity") < 20, F.col("l_linenumber")).alias("steps"), F.struct(F.col("l_linenumber").alias("input")).alias("tokens"), F.array(inner).alias("trace"))
    runs = x.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(task).alias("tasks"))
    return transcripts.objects(runs.select("id", F.lit("submission").alias("kind"), F.parse_json(F.to_json(F.struct("tasks"))).alias("payload")), having)


def artifact_results(spark, sf_dir):
    r = transcripts.results(_artifacts(spark, sf_dir, transcripts.RESULT_KEYS))
    return r.groupBy("task_id", "status", "correct", "failure_class").agg(F.count("*").alias("n"), F.sum("steps").alias("steps"), F.sum("tokens_input").alias("tokens_input"))


def artifact_steps(spark, sf_dir):
    return transcripts.steps(_artifacts(spark, sf_dir, ["kind"]))


def artifact_events(spark, sf_dir):
    """The records of a run that look like events, two a run at most."""
    e = table(spark, sf_dir, "events")
    record = F.struct("event_type", F.col("event_id").alias("step"), F.struct(F.col("user_id").cast("string").alias("task_id"), F.col("event_type").alias("result_summary")).alias("data"))
    runs = e.groupBy(F.col("user_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("event_id", record.alias("r")))).alias("rs"))
    payload = F.parse_json(F.to_json(F.col("rs.r")))
    found = transcripts.events(transcripts.objects(runs.select("id", F.lit("timeline").alias("kind"), payload.alias("payload")), transcripts.EVENT_KEYS), 2)
    return found.select("id", "task_id", "event_type", "step_index", "outcome")


def ingest_suffix(spark, sf_dir):
    """What kind of file pasted content would be."""
    e = table(spark, sf_dir, "events")
    n, k = F.col("event_id"), F.col("event_type")
    rows = F.when(n % 5 == 0, F.concat(F.lit(' [{"a": 1}, {"a": 2}] '))).when(n % 5 == 1, F.concat(k, F.lit("\tb\n\nx\ty\n"))).when(n % 5 == 2, F.concat(k, F.lit("\tb\nx\ty\tz\nplain"))).when(n % 5 == 3, F.concat(F.lit("[cut, "), k, F.lit("\n1,2]")))
    return e.select("event_id", transcripts.suffix(rows).alias("suffix"))


def dataset_summary(spark, sf_dir):
    """A dataset saved, replaced, summed up and dropped."""
    name = shared_path(spark, "dataset")
    tabular.save_dataset(table(spark, sf_dir, "nation"), name)
    tabular.save_dataset(table(spark, sf_dir, "customer"), name)
    columns, rows, sample = tabular.summary(spark, name, 5)
    frame = spark.createDataFrame([(c, rows, len(sample)) for c, _ in columns], "column string, row_count long, sampled int")
    dropped = [tabular.drop_dataset(spark, name), tabular.drop_dataset(spark, name)]
    return frame.withColumn("dropped", F.lit(str(dropped)))


QUERIES = {f.__name__: f for f in (capture_messages, capture_events, activity_lanes, activity_recent, artifact_results, artifact_steps, artifact_events, ingest_suffix, dataset_summary)}

_LIST = "[" + ", ".join(f"'{m}'" for m in _METHODS) + "]"
_METHOD_SQL = f"{_LIST}[CAST(event_id % {len(_METHODS)} + 1 AS INTEGER)]"
_STRIP = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"
_STATUS = "CASE l_returnflag WHEN 'N' THEN 'solved' WHEN 'R' THEN 'lost' END"

ORACLE_SQL = {
    "capture_messages": rf"""SELECT 'c' || conv_id AS session_id, turn, role, sha256(t) AS content_sha256, '/work' AS repo_root FROM (
  SELECT *, conv_id * 3 + turn AS n, CASE WHEN (conv_id * 3 + turn) % 2 = 0 THEN {_STRIP} ELSE regexp_replace(' ' || coalesce(text, '') || chr(10) || 'done', '^\s+|\s+$', '', 'g') END AS t FROM conversations)
  WHERE role IN ('user', 'assistant') AND t <> '' AND n % 11 <> 0 AND NOT (n % 2 = 0 AND n % 5 = 0) AND NOT (n % 2 = 1 AND n % 7 = 0)""",
    "capture_events": f"""SELECT 's' || conv_id AS session_id, turn, role, sha256({_STRIP}) AS content_sha256 FROM conversations
  WHERE role IN ('user', 'assistant') AND {_STRIP} <> ''""",
    "activity_lanes": f"""SELECT user_id, CASE WHEN m IN ('notify_turn', 'ingest_document', 'ingest_arc_artifacts') THEN 'write' WHEN m IN ('current_truth', 'context_status', 'recall_plans') THEN 'recall'
  WHEN m IN ('initialize', 'tools/list') THEN 'status' ELSE 'tool' END AS lane, count(*) AS n FROM (SELECT *, {_METHOD_SQL} AS m FROM events) GROUP BY ALL""",
    "activity_recent": f"""SELECT user_id % 16 AS log, CAST(row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id DESC) AS INTEGER) AS back, CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS ts, CASE WHEN event_id % 7 = 0 THEN 'malformed' ELSE event_type END AS event,
  CASE WHEN event_id % 7 <> 0 THEN {_METHOD_SQL} END AS method, CASE WHEN event_id % 7 = 0 THEN '#' || event_id END AS line FROM events QUALIFY back <= 40""",
    "artifact_results": f"""SELECT task_id, coalesce(s, CASE WHEN correct THEN 'solved' ELSE 'failed' END) AS status, correct, '' AS failure_class, count(*) AS n, CAST(sum(steps) AS BIGINT) AS steps, CAST(sum(tok) AS BIGINT) AS tokens_input FROM (
  SELECT DISTINCT 't' || l_partkey AS task_id, {_STATUS} AS s, coalesce({_STATUS} = 'solved', false) AS correct, CASE WHEN l_quantity < 20 THEN l_linenumber ELSE 0 END AS steps, l_linenumber AS tok, l_suppkey, l_quantity > 40 AS stalled, l_returnflag
  FROM lineitem WHERE l_returnflag IN ('N', 'R') OR l_quantity < 20) GROUP BY ALL""",
    "artifact_steps": f"SELECT l_orderkey AS id, 't' || l_partkey AS task_id, l_linenumber AS step_index, CAST(l_suppkey AS INTEGER) AS node_count, l_returnflag AS action_effect_class, l_quantity > 40 AS stalled FROM lineitem",
    "artifact_events": "SELECT user_id AS id, CAST(user_id AS VARCHAR) AS task_id, event_type, CAST(event_id AS INTEGER) AS step_index, event_type AS outcome FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 2",
    "ingest_suffix": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN '.json' WHEN 1 THEN '.tsv' WHEN 2 THEN '.csv' ELSE '.csv' END AS suffix FROM events",
    "dataset_summary": "SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment', 'c_acctbal']) AS \"column\", (SELECT count(*) FROM customer) AS row_count, 5 AS sampled, '[True, False]' AS dropped",
}
