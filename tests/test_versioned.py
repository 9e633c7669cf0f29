"""Upserts over several tables: versions, killed and racing writers; plans as rows."""

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import plans
from mnemospark.sources.versioned import Conflict, Tables, Upsert


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    return Tables(spark, f"file://{tmp_path}/store", buckets=4)


def test_versions(spark, store):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", None), (None, "z", 3.0)], "id long, name string, v double")
    b = spark.createDataFrame([("p", 1), ("q", 2)], "key string, n int")
    assert store.version() == 0 and store.read("a") is None
    assert store.commit({"a": Upsert(a, ["id"]), "b": Upsert(b, ["key", "n"])}) == {"a": {"inserted": 3, "updated": 0, "unchanged": 0}, "b": {"inserted": 2, "updated": 0, "unchanged": 0}}
    assert store.commit({"a": Upsert(a, ["id"]), "b": Upsert(b, ["key", "n"])})["a"] == {"inserted": 0, "updated": 0, "unchanged": 3}
    assert store.version() == 1 and rows(store.read("a")) == rows(a)
    more = spark.createDataFrame([(2, "w", 5.0), (2, "y", 4.0), (None, "z", 3.0), (9, None, None), (9, None, None)], "id long, name string, v double")
    assert store.commit({"a": Upsert(more, ["id"], ["v"])})["a"] == {"inserted": 1, "updated": 1, "unchanged": 1}
    assert rows(store.read("a")) == sorted([(1, "x", 1.0), (2, "w", 5.0), (None, "z", 3.0), (9, None, None)], key=str)
    assert rows(store.read("a", 1)) == rows(a) and rows(store.read("b")) == rows(b)
    assert store.commit({"a": Upsert(a.limit(0), ["id"])})["a"] == {"inserted": 0, "updated": 0, "unchanged": 0} and store.version() == 2
    with pytest.raises(ValueError):
        store.commit({"a": Upsert(b, ["key"])})


def test_a_killed_writer_shows_nothing(spark, store, monkeypatch):
    a = spark.createDataFrame([(i, i) for i in range(20)], "id int, v int")
    store.commit({"a": Upsert(a, ["id"]), "b": Upsert(a, ["id"])})
    monkeypatch.setattr(Tables, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    changed = {t: Upsert(a.withColumn("v", F.lit(7)), ["id"]) for t in "ab"}
    with pytest.raises(KeyboardInterrupt):
        store.commit(changed)
    monkeypatch.undo()
    assert store.version() == 1 and rows(store.read("a")) == rows(a)
    bad = a.withColumn("v", F.when(F.col("id") < 0, 1).otherwise(F.raise_error(F.lit("lost")).cast("int")))
    with pytest.raises(Exception, match="lost"):
        store.commit({"a": changed["a"], "b": Upsert(bad, ["id"])})
    assert store.version() == 1
    assert store.commit(changed)["b"] == {"inserted": 0, "updated": 19, "unchanged": 1} and {r.v for r in store.read("a").collect()} == {7}


def test_racing_writers(spark, store, tmp_path):
    a = spark.createDataFrame([(1, 1)], "id int, v int")
    store.commit({"a": Upsert(a, ["id"])})
    other = Tables(spark, store.root, 4)
    publish, raced = Tables._publish, []

    def late(self, version, manifest):
        if self is store and not raced:
            raced.append(other.commit({"a": Upsert(spark.createDataFrame([(2, 2)], "id int, v int"), ["id"])}))
        return publish(self, version, manifest)

    Tables._publish = late
    try:
        store.commit({"a": Upsert(spark.createDataFrame([(3, 3)], "id int, v int"), ["id"])})
    finally:
        Tables._publish = publish
    assert raced and store.version() == 3 and rows(store.read("a")) == [(1, 1), (2, 2), (3, 3)]
    Tables._publish = lambda *_: False
    try:
        with pytest.raises(Conflict):
            store.commit({"a": Upsert(spark.createDataFrame([(4, 4)], "id int, v int"), ["id"])})
    finally:
        Tables._publish = publish


def test_plans(spark, store):
    turns = [(1, 0, "user", "Make tea"), (1, 1, "assistant", "Boil water. boil  WATER. Add\tleaves! ok. x"), (2, 0, "assistant", "boil water? add leaves"), (2, 1, "assistant", "One step only"), (2, 2, "assistant", None), (3, 0, "user", None)]
    found = plans.detected(spark.createDataFrame(turns, "session_id int, turn int, role string, text string"))
    assert rows(found) == [(1, 1, "Make tea", ["Boil water", "Add leaves"]), (2, 0, "", ["boil water", "add leaves"])]
    store.commit(plans.plan_graph(found))
    plan = store.read("plans").collect()
    assert [(p.session_id, p.at, p.goal, p.n_steps, p.declared) for p in plan] == [(2, 0, "", 2, 2)]
    assert [r.text for r in store.read("plan_steps").orderBy("place").collect()] == ["boil water", "add leaves"]
    assert sorted(r.rel_type for r in store.read("plan_edges").collect()) == ["NEXT_STEP", "STEP_OF", "STEP_OF"]
    store.commit(plans.plan_graph(found))
    assert store.version() == 1
