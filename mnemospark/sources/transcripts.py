"""JSON lines of conversations, activity and run artifacts as rows: read by Spark, parsed as variants inside the JVM; objects are found in Arrow."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from mnemospark.storage import cut

# The methods of each lane, and the keys that make a record an event or a result.
WRITES = ["notify_turn", "ingest_document", "ingest_arc_artifacts", "publish_mechanic_summary", "register_plan", "report_outcome", "complete_quest", "branch_quest", "reload_dictionary"]
RECALLS = ["current_truth", "context_status", "analogical_search", "diff_since", "get_open_loops", "reconstruct_timeline"]
STATUS = ["initialize", "tools/list"]
EVENT_KEYS = ["event", "event_type", "snapshot_type", "call_type", "tool_name", "name", "action_id", "action_name", "phase", "outcome", "state_after"]
RESULT_KEYS = ["correct", "status", "final_state", "failure_class", "steps"]
SOLVED = ["correct", "solved", "success", "passed"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, at, value of every line under a folder; `at` orders the lines of one file, however it was split."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), at.alias("at"), "value")


def _get(record: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(record, f"$.{path}", kind)


def _is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def _said(content: Column) -> Column:
    """A text, or the texts of a list of parts joined by line breaks; tool calls, their results and thoughts are no text."""
    kind = lambda p: F.coalesce(_get(p, "type"), _get(p, "kind"), F.lit(""))
    texts = F.transform(
        F.try_variant_get(content, "$", "array<variant>"),
        lambda p: F.when(_is_text(p), F.try_variant_get(p, "$", "string")).when(~kind(p).isin("tool_use", "thinking", "tool_result"), _get(p, "text")),
    )
    return F.when(_is_text(content), F.try_variant_get(content, "$", "string")).otherwise(F.array_join(F.filter(texts, lambda t: t != ""), "\n"))


def _turns(rows: DataFrame) -> DataFrame:
    """Turns with a text from rows (path, at, key, sid, cwd, role, content, timestamp); the session and folder last named in a file hold from there on."""
    so_far = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    named = rows.withColumn("session_id", F.coalesce(F.last(F.nullif("sid", F.lit("")), True).over(so_far), stem)).withColumn("repo_root", F.coalesce(F.last(F.nullif("cwd", F.lit("")), True).over(so_far), F.lit("")))
    text = F.regexp_replace("content", r"^\s+|\s+$", "")
    kept = named.where(F.col("role").isin("user", "assistant")).withColumn("content", text).where("content <> ''")
    content_hash = F.sha2("content", 256)
    return kept.select(
        F.sha2(F.concat_ws("|", "path", "key", "role", "timestamp", content_hash), 256).alias("event_id"),
        "session_id", "role", "content", "timestamp", content_hash.alias("content_hash"), "repo_root", F.col("path").alias("source_path"), F.col("at").alias("source_at"),
    )


def message_turns(raw: DataFrame) -> DataFrame:
    """Turns of transcripts with one message a line. raw: path, at, value.

    Malformed lines, meta rows and tool results are left out; a session
    or folder that they name holds for the lines after them all the same.
    """
    r = raw.select("path", "at", F.sha2("value", 256).alias("line"), F.try_parse_json("value").alias("r"))
    v = F.col("r")
    plain = _get(v, "type").isin("user", "assistant") & _get(v, "toolUseResult", "variant").isNull() & (F.coalesce(_get(v, "sourceToolAssistantUUID"), F.lit("")) == "") & ~F.coalesce(_get(v, "isMeta", "boolean"), F.lit(False)) & (F.coalesce(_get(v, "sourceToolUseID"), F.lit("")) == "")
    return _turns(r.select(
        "path", "at", F.coalesce(_get(v, "uuid"), "line").alias("key"), _get(v, "sessionId").alias("sid"), _get(v, "cwd").alias("cwd"),
        F.when(plain, F.coalesce(_get(v, "message.role"), _get(v, "type"))).alias("role"), _said(_get(v, "message.content", "variant")).alias("content"), _get(v, "timestamp").alias("timestamp"),
    ))


def event_turns(raw: DataFrame) -> DataFrame:
    """Turns of transcripts with one event a line: its payload is a message of the user or the agent, or names session and folder. raw: path, at, value."""
    r = raw.select("path", "at", F.sha2("value", 256).alias("key"), F.try_parse_json("value").alias("r"))
    v, kind = F.col("r"), _get(F.col("r"), "type")
    said = F.when(_get(v, "payload.type") == "user_message", "user").when(_get(v, "payload.type") == "agent_message", "assistant")
    return _turns(r.select(
        "path", "at", "key", F.when(kind == "session_meta", _get(v, "payload.id")).alias("sid"), F.when(kind.isin("session_meta", "turn_context"), _get(v, "payload.cwd")).alias("cwd"),
        F.when(kind == "event_msg", said).alias("role"), _get(v, "payload.message").alias("content"), _get(v, "timestamp").alias("timestamp"),
    ))


def chat_turns(raw: DataFrame) -> DataFrame:
    """Turns of chat exports with a batch of requests a line: what was asked, then the answer's parts. raw: path, at, value.

    A line's `v` is a session with its requests, or a list of requests that
    hold a message. A part of an answer counts by its value, or its content's;
    parts that only tell of tools or progress are left out.
    """
    v = F.try_parse_json("value")
    r = raw.select("path", "at", v.alias("r"))
    listed = F.coalesce(F.try_variant_get("r", "$.v.requests", "array<variant>"), F.filter(F.try_variant_get("r", "$.v", "array<variant>"), lambda q: _get(q, "message", "variant").isNotNull()))
    asked = r.select("path", "at", F.when(F.schema_of_variant(F.try_variant_get("r", "$.v", "variant")).startswith("OBJECT"), _get(F.col("r"), "v.sessionId")).alias("sid"), F.posexplode_outer(listed).alias("place", "q"))
    q = F.col("q")
    part = lambda p: F.coalesce(F.when(_is_text(_get(p, "value", "variant")), _get(p, "value")), _get(p, "content.value"), F.when(_is_text(p), F.try_variant_get(p, "$", "string")))
    answer = F.array_join(F.filter(F.transform(_get(q, "response", "array<variant>"), part), lambda t: t.isNotNull()), "")
    said = F.array(F.struct(F.lit("user").alias("role"), _get(q, "message.text").alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content")))
    each = asked.select("path", "at", "place", "sid", F.coalesce(_get(q, "requestId"), F.col("at").cast("string")).alias("key"), _get(q, "timestamp").alias("timestamp"), F.posexplode(said).alias("side", "s"))
    return _turns(each.select("path", F.struct("at", "place", "side").alias("at"), "key", "sid", F.lit(None).cast("string").alias("cwd"), "s.role", F.coalesce("s.content", F.lit("")).alias("content"), "timestamp"))


def lane(method: Column) -> Column:
    """write, recall, status or tool."""
    return F.when(method.isin(WRITES), "write").when(method.isin(RECALLS) | method.startswith("recall_"), "recall").when(method.isin(STATUS), "status").otherwise("tool")


def recent(raw: DataFrame, n: int) -> DataFrame:
    """The last n lines of each file as ts, event, method, line; one that is no JSON becomes a `malformed` record. raw: path, at, value."""
    last = raw.withColumn("back", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("at")))).where(F.col("back") <= n)
    v = F.try_parse_json("value")
    return last.select("path", "back", F.coalesce(_get(v, "ts"), F.lit("")).alias("ts"), F.when(v.isNull(), "malformed").otherwise(_get(v, "event")).alias("event"), _get(v, "method").alias("method"), F.when(v.isNull(), F.col("value")).alias("line"))


def suffix(content: Column) -> Column:
    """.json for a JSON array, .tsv where the first ten lines hold tabs in at most two counts and the first holds one, else .csv."""
    text = F.regexp_replace(F.coalesce(content, F.lit("")), r"^\s+|\s+$", "")
    full = F.filter(F.slice(F.split(text, "\n"), 1, 10), lambda line: F.trim(F.regexp_replace(line, r"\s", " ")) != "")
    tabs = F.transform(full, lambda line: F.length(line) - F.length(F.replace(line, F.lit("\t"), F.lit(""))))
    array = text.startswith("[") & text.endswith("]") & F.try_parse_json(text).isNotNull()
    return F.when(array, ".json").when((F.get(tabs, F.lit(0)) > 0) & (F.size(F.array_distinct(tabs)) <= 2), ".tsv").otherwise(".csv")


#: Bytes of an Arrow batch, and of the objects that are handed on at once, about.
BATCH_BYTES = 4 << 20


def _walked(having: list[str] | None):
    """Tasks of objects(): rows id, kind, payload (JSON) to rows id, kind, place, item (JSON), keys. Numbers with a point keep their digits."""
    import json
    from uuid import uuid4

    import pyarrow as pa

    wanted, mark = having and frozenset(having), uuid4().hex
    bare = re.compile(f'"{mark}([^"]*)"')

    def found(text, load, dump):
        todo = [((), load(text))]
        while todo:
            place, value = todo.pop()
            if isinstance(value, dict):
                if wanted is None or not wanted.isdisjoint(value):
                    item = dump(value)
                    yield place, bare.sub(r"\1", item) if mark in item else item, list(value)
                value = value.values()
            todo.extend([((*place, i), v) for i, v in enumerate(value) if isinstance(v, (dict, list))])

    def made(batch, rows, places, items, keys):
        rows = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("kind").take(rows), pa.array(places, pa.list_(pa.int32())), pa.array(items, pa.string()), pa.array(keys, pa.list_(pa.string()))], names=["id", "kind", "place", "item", "keys"])

    def run(batches):
        load, dump = json.JSONDecoder(parse_float=mark.__add__).decode, json.JSONEncoder(separators=(",", ":")).encode
        for batch in batches:
            out, size = ([], [], [], []), 0
            for row, text in enumerate(batch.column("payload").to_pylist()):
                for place, item, keys in found(text, load, dump) if text[:1] in ("{", "[") else ():
                    for column, value in zip(out, (row, place, item, keys), strict=True):
                        column.append(value)
                    size += len(item)
                    if size > BATCH_BYTES:
                        yield made(batch, *out)
                        out, size = ([], [], [], []), 0
            yield made(batch, *out)

    return run


def objects(payloads: DataFrame, having: list[str] | None = None) -> DataFrame:
    """id, kind, place, item, keys of every object in payloads (id, kind, payload as a variant), however deep; `place` is its way down.

    having: only objects with one of these keys. A payload is walked in one
    pass in Arrow; what is found is stored, as text.
    """
    payloads.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    texts = payloads.where("payload IS NOT NULL").select("id", "kind", F.to_json("payload").alias("payload"))
    kinds = {c: texts.schema[c].dataType for c in ("id", "kind")}
    schema = StructType([*[StructField(c, k) for c, k in kinds.items()], StructField("place", ArrayType(IntegerType())), StructField("item", StringType()), StructField("keys", ArrayType(StringType()))])
    found = cut(texts.mapInArrow(_walked(having), schema), "objects")
    # Exploded, as a plain column would be parsed anew for each use of it.
    return found.select("id", "kind", "place", F.explode(F.array_repeat(F.parse_json("item"), 1)).alias("item"), "keys")


def _any_key(keys: list[str]) -> Column:
    return F.arrays_overlap("keys", F.array(*map(F.lit, keys)))


def _first(item: Column, *keys: str) -> Column:
    return F.coalesce(*[F.nullif(_get(item, k), F.lit("")) for k in keys])


def results(found: DataFrame) -> DataFrame:
    """Result records among objects(): task_id, puzzle_id, status, correct, steps, tokens_input, failure_class; equal records count once."""
    # Each field is read once; a plain column would be read anew for each use of it.
    names = ["task_id", "task", "id", "puzzle_id", "game_id", "dataset_id", "status", "final_state", "steps", "step_count", "num_steps", "tokens_input", "input_tokens", "tokens.input", "failure_class", "error_class", "error_message"]
    fields = F.struct(*[_get(F.col("item"), n).alias(n.replace(".", "_of_")) for n in names], _get(F.col("item"), "correct", "boolean").alias("correct"))
    read = found.where(_any_key(RESULT_KEYS)).select("kind", "item", F.explode(F.array_repeat(fields, 1)).alias("f"))
    first = lambda *keys: F.coalesce(*[F.when(F.col(f"f.{k}") != "", F.col(f"f.{k}")) for k in keys])
    task, puzzle = first("task_id", "task", "id"), first("puzzle_id", "game_id", "dataset_id")
    correct = F.coalesce("f.correct", F.lower("f.status").isin(SOLVED), F.lit(False))
    rows = read.where(task.isNotNull() | puzzle.isNotNull()).select(
        "kind", F.sha2(F.to_json("item"), 256).alias("hash"), F.coalesce(task, F.lit("")).alias("task_id"), F.coalesce(puzzle, F.lit("")).alias("puzzle_id"),
        F.coalesce(first("status", "final_state"), F.when(correct, "solved").otherwise("failed")).alias("status"), correct.alias("correct"),
        F.coalesce(first("steps", "step_count", "num_steps").try_cast("int"), F.lit(0)).alias("steps"), F.coalesce(first("tokens_input", "input_tokens", "tokens_of_input").try_cast("int"), F.lit(0)).alias("tokens_input"),
        F.coalesce(first("failure_class", "error_class", "error_message"), F.lit("")).alias("failure_class"),
    )
    return rows.distinct()  # equal hashes: equal records


def events(found: DataFrame, most: int | None = None) -> DataFrame:
    """Event records among objects(), in the order of id and place; `most` keeps the first ones of each id, None all."""
    v = F.col("item")
    rows = found.where(_any_key(EVENT_KEYS))
    if most is not None:
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("kind", "place"))).where(F.col("nth") <= most)
    return rows.select(
        "id", "kind", "place", F.coalesce(_first(v, "task_id", "task", "data.task_id"), F.lit("")).alias("task_id"),
        F.coalesce(_first(v, "event_type", "snapshot_type", "event", "call_type", "data.call_type"), "kind").alias("event_type"),
        F.coalesce(_first(v, "step", "step_index", "step_num", "data.step").try_cast("int"), F.lit(0)).alias("step_index"),
        F.coalesce(_first(v, "outcome", "state_after", "phase_answer", "data.result_summary"), F.lit("")).alias("outcome"),
    )


def steps(found: DataFrame) -> DataFrame:
    """World-model steps among objects(): task_id, step_index, node_count, action_effect_class, stalled."""
    v = F.col("item")
    return found.where(_any_key(["kind"]) & (_get(v, "kind") == "world_model_step")).select(
        "id", F.coalesce(_get(v, "task_id"), F.lit("")).alias("task_id"), F.coalesce(_get(v, "step").try_cast("int"), F.lit(0)).alias("step_index"), F.coalesce(_get(v, "data.node_count").try_cast("int"), F.lit(0)).alias("node_count"),
        F.coalesce(_get(v, "data.action_effect_class"), F.lit("")).alias("action_effect_class"), F.coalesce(_get(v, "data.single_action_stall_detected", "boolean"), F.lit(False)).alias("stalled"),
    )
