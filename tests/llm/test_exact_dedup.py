"""Exact duplicates against a dictionary, and the directory's invariants."""

from collections import defaultdict

import pytest

from mnemospark.llm.exact_dedup import Directory, _own, build_index, drop_exact_duplicates, exact_duplicates, keyed

import pandas as pd


def brute(rows):
    upper = {c: c + 32 for c in range(65, 91)}
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(upper)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), i == keep) for i in ids]
    return sorted(out, key=str)


CASES = [(1, "Ab", "x"), (2, "aB", None), (3, None, "x"), (4, "", "y"), (5, "É", "z"), (6, "é", "z"), (None, "ab", "q"), (7, "long " * 50000, "l"),
         (8, "Long " * 50000, "l"), (9, "same", "s"), (9, "same", "s"), (None, "alone", "n")] + [(100 + k, "hot", "h") for k in range(300)]


@pytest.mark.parametrize("capacity", [1, 4096])
def test_against_brute_force(spark, capacity):
    docs = spark.createDataFrame([(i, t, s, "clash", 5) for i, t, s in CASES], "doc_id long, text string, key string, digest string, bucket int").repartition(3)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(docs, capacity).collect()), key=str)
    assert got == brute(CASES)


def test_large_ids_beside_missing_ones(spark):
    docs = spark.createDataFrame([(2**60 + 1, "a"), (2**60 + 3, "a"), (None, "a"), (None, "b"), (None, "b")], "doc_id long, text string").coalesce(1)
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_duplicates(docs).where("group_size = 3").collect()} == {(2**60 + 1, 2**60 + 3, False), (2**60 + 3, 2**60 + 3, True), (None, 2**60 + 3, False)}
    assert sorted(str(r.doc_id) for r in drop_exact_duplicates(docs).collect()) == [str(2**60 + 3), "None"]


def test_rows_find_their_group_through_the_directory(spark):
    docs = spark.createDataFrame([(k, f"t{k % 700}") for k in range(2000)], "doc_id long, text string")
    index = build_index(docs, 8)
    assert index.depth > 4 and index.directory.count() == 1 << index.depth
    sizes = [r["count"] for r in index.rows.groupBy("bucket").count().collect()]
    assert max(sizes) <= 8 and sum(sizes) == 700
    found = index.find(keyed(docs).drop("text"), ["doc_id"]).collect()
    assert len(found) == 2000 and all(r.keep_id % 700 == r.doc_id % 700 for r in found)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_duplicates(docs).collect() == []
    assert drop_exact_duplicates(docs).collect() == []


def test_filter_keeps_columns_and_one_row(spark):
    docs = spark.createDataFrame([(i, t, s) for i, t, s in CASES], "doc_id long, text string, key string")
    kept = drop_exact_duplicates(docs, 2)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["2", "4", "5", "6", "8", "9", "None", "399"])


def test_colliding_keys_are_told_apart_by_bytes():
    batch = pd.DataFrame({"bucket": [0] * 3, "key": [7] * 3, "digest": ["a", "b", "a"], "text": ["x", "y", "x"], "max_id": ["1", "2", "5"], "n": [1, 1, 1], "n_top": [1, 1, 1]})
    (out,) = list(_own(iter([batch])))
    assert out[["chain", "keep_id", "group_size", "n_keep"]].values.tolist() == [[0, 5, 2, 1], [1, 2, 1, 1]]


def test_directory_splits_and_doubles():
    d = Directory({0: 10, 1: 1, 2: 1, 3: 1}, 2, 5)
    assert d.global_depth == 2 and len(d.pointers) == 4
    assert d.bucket_of_slot()[2] == d.bucket_of_slot()[3]
    assert Directory({}, 4, 5).global_depth == 0
