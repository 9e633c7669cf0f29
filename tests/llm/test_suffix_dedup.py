"""Repeated spans against all passages in a dictionary."""

import random
from collections import defaultdict

import numpy as np
import pytest

from mnemospark.llm._common import materialise
from mnemospark.llm.suffix_dedup import LEAST, WINDOW, cut_repeats, minimisers, repeated, repeated_spans, rolling


def brute(rows):
    """doc_id -> repeated words, for rows with distinct ids."""
    first = {}
    where = defaultdict(list)
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").split()
        for k in range(len(w) - LEAST + 1):
            key = tuple(w[k : k + LEAST])
            first.setdefault(key, i)
            where[i].append((k, key))
    marked = {}
    for i, found in where.items():
        words = {k + j for k, key in found if first[key] != i for j in range(LEAST)}
        if words:
            marked[i] = words
    return marked


def corpus():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [text(n) for n in (49, 50, 51, 60, 120, 400)]
    docs = []
    for i in range(60):
        parts = text(rng.randrange(0, 80))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.choice([0, 0, 10])
            parts += p[a:] + text(rng.randrange(0, 60))
        docs.append((i * 3, " \n".join(" ".join(parts[k : k + 9]) for k in range(0, len(parts), 9))))
    docs += [(500, docs[4][1]), (501, docs[4][1]), (502, None), (503, ""), (504, "same " * 300), (505, "same " * 120), (506, "a\x1cb " * 80), (507, "a\x1cb " * 80)]
    return docs


def test_spans_against_all_passages(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, place int, doc string").repartition(5)
    marked = defaultdict(set)
    texts = dict(rows)
    for r in repeated_spans(docs).collect():
        words = set(range(r.start_word, r.start_word + r.n_words))
        assert not words & marked[r.doc_id] and r.first_doc_ids and min(r.first_doc_ids) < r.doc_id
        marked[r.doc_id] |= words
        assert texts[r.doc_id][r.begin : r.end].split() == texts[r.doc_id].split()[r.start_word : r.start_word + r.n_words]
    assert marked == brute(rows)


def test_cut(spark):
    rows = corpus() + [(None, "a b"), (9000, "tail"), (9000, "tail")]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    cut = cut_repeats(docs)
    assert cut.columns == docs.columns
    got = defaultdict(list)
    for r in cut.collect():
        got[r.doc_id].append(r)
    marked = brute(rows)
    for i, t in rows:
        left = [w for k, w in enumerate((t or "").split()) if k not in marked.get(i, ())]
        if i in marked and not left:
            assert i not in got
        else:
            assert all((r.text or "").split() == left and r.n_chars == len(r.text or "") for r in got[i]) and got[i]
    assert len(got[9000]) == 2
    assert cut_repeats(docs.limit(0)).collect() == []


def test_hot_run_spreads_over_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(7, b"%06d" % d) for d in range(2000)] + [(int(s), b"x%06d" % k) for k, s in enumerate(rng.integers(100, 2**40, 500))] + [(-9, b"a"), (9, b"b")]
    table = materialise(spark.createDataFrame(rows, "suffix long, doc binary"), "suffixes")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = repeated(table).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(bytes(r.doc) for r in got) == [b"%06d" % d for d in range(2000)]


def test_edges_of_ranges_meet(spark):
    """Equal suffixes of which each range holds one."""
    rows = [(s, b"%d" % d) for s in range(40) for d in range(s % 3 + 1)]
    table = materialise(spark.createDataFrame(rows, "suffix long, doc binary"), "suffixes")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        got = repeated(table).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == sum(s % 3 + 1 for s in range(40) if s % 3)


@pytest.mark.parametrize("partitions", [1, 3, 23])
def test_passage_in_every_document_over_many_ranges(spark, partitions):
    """A run of equal suffixes is cut into ranges, with contexts that only some of its documents share."""
    rng = random.Random(partitions)
    words = [f"v{k}" for k in range(500)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    core, sides = text(40), [text(30) for _ in range(4)]
    rows = [(i, " ".join(text(rng.randrange(12)) + rng.choice(sides)[rng.randrange(30) :] + core + rng.choice(sides)[: rng.randrange(30)] + text(rng.randrange(12)))) for i in range(150)]
    rows += [(1000 + i, "  " + " ".join(core * 3) + "\n\n" + " ".join(sides[i % 4] + core)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = repeated_spans(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    marked, texts = defaultdict(set), dict(rows)
    for r in got:
        marked[r.doc_id] |= set(range(r.start_word, r.start_word + r.n_words))
        assert texts[r.doc_id][r.begin : r.end].split() == texts[r.doc_id].split()[r.start_word : r.start_word + r.n_words]
    assert marked == brute(rows)


def test_large_ids_beside_missing_ones(spark):
    passage = " ".join(f"p{k}" for k in range(70))
    rows = [(2**60 + 1, passage + " a"), (2**60 + 3, passage + " b"), (None, passage + " c"), (None, None)]
    got = repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.first_doc_ids) for r in got) == [(str(2**60 + 3), 70, [2**60 + 1]), ("None", 70, [2**60 + 1])]


def test_minimisers_and_rolling():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 2**63, 500).astype(np.uint64)
    h = rolling(words, 7)
    again = rolling(np.concatenate((words[:3], words[100:107])), 7)
    assert len(h) == 494 and again[-1] == h[100] and len(np.unique(h)) == len(h)
    grams = rolling(words, 26)
    at, first, count = minimisers(grams)
    owner = np.repeat(at, count)
    assert len(owner) == len(grams) - WINDOW + 1 and (first == np.cumsum(count) - count).all()
    assert all(owner[a] == a + grams[a : a + WINDOW].argmin() for a in range(len(owner)))
    assert len(at) < 3 * 475 / WINDOW and len(minimisers(np.zeros(3, np.uint64))[0]) == 0
