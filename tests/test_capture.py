"""Transcripts, activity lines, artifacts, repairs and reified concepts on small cases."""

import json

from pyspark.sql import functions as F

from mnemospark.operators import audit
from mnemospark.sources import tabular, transcripts


def put(tmp_path, name, rows):
    (tmp_path / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_message_turns(spark, tmp_path):
    message = lambda content, **more: {"type": "user", "timestamp": "1", "message": {"role": "user", "content": content}} | more
    put(tmp_path, "one.jsonl", [
        message("before"), {"type": "summary", "sessionId": "s9", "cwd": "/w"}, "{cut", "", "[1]", message("  hi \n"), message("[not, json"), message('["a"]'), message(""), message(None),
        message([{"type": "text", "text": "a"}, "b", {"type": "thinking", "text": "no"}, {"kind": "tool_use"}, {"type": "text", "text": 3.5}, 7]), message("meta", isMeta=True), message("out", toolUseResult={"x": 1}), message("t", sourceToolUseID="1"),
    ])
    put(tmp_path, "two.jsonl", [message("x", type="system"), message("other", uuid="u1")])
    rows = transcripts.message_turns(transcripts.lines(spark, str(tmp_path))).collect()
    got = [(r.session_id, r.content, r.repo_root) for r in sorted(rows, key=lambda r: (r.source_path, r.source_at))]
    texts = [g[1] for g in got]
    assert got[0] == ("one", "before", "") and got[1] == ("s9", "hi", "/w") and got[-1] == ("two", "other", "")
    assert texts[1:4] == ["hi", "[not, json", '["a"]'] and texts[4].split("\n")[:2] == ["a", "b"] and "no" not in texts[4]
    assert not {"meta", "out", "t", "x"} & set(texts) and len({r.event_id for r in rows}) == len(rows)


def test_event_turns(spark, tmp_path):
    said = lambda kind, text: {"type": "event_msg", "timestamp": "1", "payload": {"type": kind, "message": text}}
    put(tmp_path, "a.jsonl", [said("user_message", "q"), {"type": "session_meta", "payload": {"id": "s1", "cwd": "/a"}}, said("agent_message", " r "), {"type": "turn_context", "payload": {"cwd": "/b"}}, said("token_count", "no"), said("user_message", " "), said("user_message", "z"), {"type": "other"}, "null"])
    rows = transcripts.event_turns(transcripts.lines(spark, str(tmp_path))).orderBy("source_at").collect()
    assert [(r.session_id, r.role, r.content, r.repo_root) for r in rows] == [("a", "user", "q", ""), ("s1", "assistant", "r", "/a"), ("s1", "user", "z", "/b")]


def test_recent_and_lane(spark, tmp_path):
    put(tmp_path, "log", [{"ts": str(i), "event": "e", "method": "notify_turn"} for i in range(5)] + ["broken"])
    rows = transcripts.recent(transcripts.lines(spark, str(tmp_path)), 3).orderBy("back").collect()
    assert [(r.event, r.ts, r.line) for r in rows] == [("malformed", "", "broken"), ("e", "4", None), ("e", "3", None)]
    lanes = spark.createDataFrame([("recall_x",), ("initialize",), ("report_outcome",), (None,)], "m string").select(transcripts.lane(F.col("m")).alias("l"))
    assert [r.l for r in lanes.collect()] == ["recall", "status", "write", "tool"]


def test_suffix(spark):
    texts = ['[{"a": 1}]', "[1,", "a\tb\nc\td", "a\tb\nc\nd\te\tf", "a,b", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(transcripts.suffix(F.col("t")).alias("s"))
    assert [r.s for r in df.collect()] == [".json", ".csv", ".tsv", ".csv", ".csv", ".csv", ".csv"]


def test_artifacts(spark):
    item = {"task_id": "t1", "correct": None, "status": "Solved", "steps": "4", "tokens": {"input": 9}}
    payloads = [(1, "k", json.dumps({"runs": [item, item, {"deep": [{"game_id": "g", "failure_class": "x"}]}, {"task_id": "bare"}]})), (2, "k", "[]"), (3, "k", "7"), (4, "k", None)]
    df = spark.createDataFrame(payloads, "id long, kind string, p string").select("id", "kind", F.parse_json("p").alias("payload"))
    rows = transcripts.results(transcripts.objects(df)).orderBy("task_id").collect()
    assert [(r.task_id, r.puzzle_id, r.status, r.correct, r.steps, r.tokens_input, r.failure_class) for r in rows] == [("", "g", "failed", False, 0, 0, "x"), ("t1", "", "Solved", True, 4, 9, "")]
    assert transcripts.results(transcripts.objects(df.where("id > 2"))).count() == 0
    made = spark.createDataFrame([(1, "tl", json.dumps([{"event": f"e{i}", "step": i} for i in range(12)]))], "id long, kind string, p string").select("id", "kind", F.parse_json("p").alias("payload"))
    assert [r.step_index for r in transcripts.events(transcripts.objects(made), 11).orderBy("place").collect()] == list(range(11))
    assert transcripts.events(transcripts.objects(made)).count() == 12


def test_dataset(spark, tmp_path):
    path = str(tmp_path / "d")
    tabular.save_dataset(spark.range(3), path)
    tabular.save_dataset(spark.range(7), path)
    columns, rows, sample = tabular.summary(spark, path, 2)
    assert (columns, rows, len(sample)) == ([("id", "bigint")], 7, 2)
    assert tabular.drop_dataset(spark, path) and not tabular.drop_dataset(spark, path)


def test_polarity(spark):
    rows = [(1, "Plan outcome (success): revert and undo", None), (2, "Plan outcome (failure): revert", False), (3, "Plan outcome (success): hm", False), (4, "Plan outcome (success): revert", True), (5, "Plan outcome (success): revert [valence_relabel: y]", False), (6, None, False), (7, "Plan outcome (maybe): revert", False)]
    got = {r.id: (r.action, r.new_text) for r in audit.polarity_repairs(spark.createDataFrame(rows, "id long, text string, archived boolean")).collect()}
    assert got == {1: ("flip", "Plan outcome (failure): revert and undo\n[valence_relabel: was success]"), 3: ("archive", None)}


def test_retrospective(spark):
    rows = [("a", 1, i, f"s{i}", [1.0, 0.0]) for i in range(7)] + [("b", 1, i, "x", [0.0, 1.0]) for i in range(3)] + [("c", 1, 0, "y", [0.0, 1.0]), (None, 1, 0, "z", [1.0, 0.0]), ("a", 1, -1, " ", [1.0, 0.0])]
    items = spark.createDataFrame(rows, "session string, domain int, at int, text string, v array<double>")
    plans = spark.createDataFrame([(1, [0.0, 2.0])], "domain int, v array<double>")
    got = audit.retrospective(items, plans).collect()
    assert [(r.session, r.goal, r.steps) for r in got] == [("a", "s0", ["s0", "s1", "s2", "s3", "s4"])]


def test_dictionary_and_reify(spark):
    entries = spark.createDataFrame([(" API ", ["Interface", "api", "interface"]), ("", ["x"]), (None, ["y"]), ("db", None)], "name string, labels array<string>")
    stored = spark.createDataFrame([("db", "DB", ["store"])], "key string, name string, labels array<string>")
    got = {r.key: (r.name, r.labels, r.is_new) for r in audit.dictionary(entries, stored).collect()}
    assert got == {"api": ("API", ["Interface"], True), "db": ("DB", ["store"], False)}
    concepts = spark.createDataFrame([(1, "decision", "t", 0.95, 5, 7), (2, "noise", "t", 0.9, 5, 7), (3, None, "t", 0.9, 5, 7), (4, "decision", "t", 0.5, 5, 7), (5, "decision", None, 0.7, None, 7)], "id long, kind string, text string, confidence double, message long, session long")
    made, links = audit.reify(concepts)
    assert sorted(r.confidence_low for r in made.collect()) == [False, True] and links.count() == 5


def test_objects_are_walked_in_one_pass(spark, tmp_path, monkeypatch):
    """Objects of many levels, with their places; only what is deeper than a pass is stored for the next one."""
    deep = {"k": 0}
    for _ in range(21):
        deep = {"a": [deep, "}]"]}
    payloads = [(1, json.dumps({"a": [{"b": 1}, 2, {"c": {"d": []}}, {}], "t": 'x"{['})), (2, json.dumps([[], [{"b": 2}]])), (3, "7"), (4, None), (5, json.dumps(deep))]
    df = spark.createDataFrame(payloads, "id long, p string").select("id", F.lit("k").alias("kind"), F.parse_json("p").alias("payload"))
    stored = []
    monkeypatch.setattr(transcripts, "cut", lambda frame, name, cut=transcripts.cut: stored.append(name) or cut(frame, name))
    got = {(r.id, tuple(r.place), r.item) for r in transcripts.objects(df.where("id < 5")).select("id", "place", F.to_json("item").alias("item")).collect()}
    assert got == {
        (1, (), '{"a":[{"b":1},2,{"c":{"d":[]}},{}],"t":"x\\"{["}'), (1, (0, 0), '{"b":1}'), (1, (0, 2), '{"c":{"d":[]}}'), (1, (0, 2, 0), '{"d":[]}'), (1, (0, 3), "{}"), (2, (1, 0), '{"b":2}'),
    }
    assert len(stored) == 1
    found = transcripts.objects(df).where("id = 5").collect()
    assert sorted(len(r.place) for r in found) == list(range(0, 43, 2))


def test_retrospective_meets_vectors_in_blocks(spark):
    """One large domain is no single task's work: goals and plans meet in blocks, with the rows that comparing all of them leaves."""
    vector = lambda i: None if i % 50 == 7 else [0.0, 0.0] if i % 50 == 8 else [1.0] if i % 50 == 9 else [float(i % 17), float(i % 23)]
    goals, plans = [(f"g{i}", i % 2, vector(i)) for i in range(300)], [(1, vector(i * 31 + 3)) for i in range(12)] + [(None, [1.0, 1.0]), (0, None)]
    items = spark.createDataFrame([(s, d, k, f"{s} {k}", v) for s, d, v in goals for k in range(3)], "session string, domain int, at int, text string, v array<double>")
    made = audit.retrospective(items, spark.createDataFrame(plans, "domain int, v array<double>"))

    def like(a, b):
        if a is None or b is None or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    assert sorted(r.session for r in made.collect()) == sorted(s for s, d, v in goals if not any(d == e and like(v, w) > 0.9 for e, w in plans))
    assert "MapInArrow" in made._jdf.queryExecution().toString()


def test_objects_keep_their_values_and_are_chosen_by_key(spark):
    """Numbers keep their digits, texts their letters, however deep; unwanted objects are not handed on."""
    item = '{"a":1.50,"b":[-0.25,12345678901234567890123456789,null,true],"c":"1.50 \\u0000 \\ud83d\\ude00 \\" é","steps":{"e":2.25}}'
    deep = '{"a":[' * 300 + '{"steps":0.10}' + "]}" * 300
    df = spark.createDataFrame([(1, f"[{item}]"), (2, deep), (3, "1.5"), (4, '"{"')], "id long, p string").select("id", F.lit("k").alias("kind"), F.parse_json("p").alias("payload"))
    every = {(r.id, len(r.place)): r for r in transcripts.objects(df).select("*", F.to_json("item").alias("text")).collect()}
    first, inner, most = spark.createDataFrame([(item, '{"e":2.25}', deep)], "a string, b string, c string").select(*[F.to_json(F.parse_json(c)) for c in "abc"]).first()
    assert every[1, 1].text == first and every[1, 1]["keys"] == ["a", "b", "c", "steps"] and every[1, 2].text == inner and every[1, 2].place == [0, 3]
    assert every[2, 0].text == most and len(every) == 2 + 301
    assert sorted((r.id, len(r.place)) for r in transcripts.objects(df, ["steps"]).collect()) == [(1, 1), (2, 600)]
