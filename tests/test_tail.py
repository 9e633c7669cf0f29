"""Growing files: each ended line once, newest files first, bounded backfill; chat exports."""

import json
import os

import pytest

from mnemospark.sources import tail, transcripts
from mnemospark.sources.versioned import Tables


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    return tmp_path / "in"


def write(path, text, mode="a", at=None):
    with open(path, mode) as f:
        f.write(text)
    if at is not None:
        os.utime(path, (at, at))


def lines(store):
    return {(r.path.rsplit("/", 1)[1], r.at, r.value) for r in store.read("lines").collect()}


def test_appended_lines_once(spark, tmp_path, folder, monkeypatch):
    monkeypatch.setattr(tail, "BLOCK", 8)
    store, a, b = Tables(spark, f"file://{tmp_path}/state"), folder / "a.jsonl", folder / "sub" / "b.jsonl"
    write(a, "one\ntwo\nthr")
    write(b, "é1\n" + "x" * 50 + "\n")
    write(folder / "other.txt", "no\n")
    assert tail.drain(spark, f"file://{folder}", store) == 4
    want = {("a.jsonl", 0, "one"), ("a.jsonl", 4, "two"), ("b.jsonl", 0, "é1"), ("b.jsonl", 4, "x" * 50)}
    assert lines(store) == want
    assert tail.drain(spark, f"file://{folder}", store) == 0
    write(a, "ee\nfour\n")
    assert tail.drain(spark, f"file://{folder}", store) == 2
    want |= {("a.jsonl", 8, "three"), ("a.jsonl", 14, "four")}
    assert lines(store) == want
    write(b, "new\n", "w")  # cut off: read from the start
    assert tail.drain(spark, f"file://{folder}", store) == 1
    assert lines(store) == want | {("b.jsonl", 0, "new")}


def test_newest_first_and_bounds(spark, tmp_path, folder):
    store = Tables(spark, f"file://{tmp_path}/state")
    for k in range(3):
        write(folder / f"f{k}.jsonl", "".join(f"{k}-{i}\n" for i in range(30)), at=1000 + k)
    assert tail.scan(tail.listing(spark, f"file://{folder}"), store, most=25, backfill=20) == 25
    got = lines(store)
    assert {v for _, _, v in got} == {f"2-{i}" for i in range(10, 30)} | {f"1-{i}" for i in range(10, 15)}
    assert tail.drain(spark, f"file://{folder}", store, most=25, backfill=20) == 35
    assert {v for _, _, v in lines(store)} == {f"{k}-{i}" for k in range(3) for i in range(10, 30)}


def test_a_killed_scan_takes_nothing(spark, tmp_path, folder, monkeypatch):
    store = Tables(spark, f"file://{tmp_path}/state")
    write(folder / "a.jsonl", "one\n")
    monkeypatch.setattr(Tables, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        tail.drain(spark, f"file://{folder}", store)
    monkeypatch.undo()
    assert store.read("lines") is None and tail.drain(spark, f"file://{folder}", store) == 1


def test_chat_exports(spark, folder):
    session = {"v": {"sessionId": "s1", "requests": [
        {"requestId": "r1", "timestamp": 5, "message": {"text": " hello "}, "response": [{"value": "a"}, {"kind": "tool"}, {"content": {"value": "b"}}, "c"]},
        {"requestId": "r2", "message": {"text": ""}, "response": [{"value": "only"}]},
    ]}}
    later = {"v": [{"requestId": "r3", "message": {"text": "again"}}, {"no": "message"}]}
    write(folder / "chat.jsonl", json.dumps(session) + "\nnot json\n" + json.dumps({"v": 3}) + "\n" + json.dumps(later) + "\n")
    got = transcripts.chat_turns(transcripts.lines(spark, f"file://{folder}")).orderBy("source_at").collect()
    assert [(r.session_id, r.role, r.content) for r in got] == [("s1", "user", "hello"), ("s1", "assistant", "abc"), ("s1", "assistant", "only"), ("s1", "user", "again")]
    assert len({r.event_id for r in got}) == 4
