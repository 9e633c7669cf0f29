"""Full-text search against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import search


@pytest.mark.parametrize("itself", [True, False])
def test_bm25_hands_on_few_rows(spark, monkeypatch, itself):
    """Every part hands on about k rows a query, copies and long documents included, and the best of them are the best of all."""
    monkeypatch.setattr(search, "FEWEST", 100)
    rng = random.Random(5)
    texts = {i: " ".join(rng.choice(["alpha", "beta", f"w{rng.randrange(30)}"]) for _ in range(rng.randrange(1, 12))) for i in range(200)} | {i: "alpha copy copy" for i in range(200, 400)} | {400: "alpha " * 500, 401: "", 402: None}
    t = search.terms(spark.createDataFrame(list(texts.items()), "id long, text string")).cache()
    asked = t.where("id % 50 = 0").selectExpr("id AS query_id", "term").unionByName(spark.createDataFrame([(7, "nowhere")], "query_id long, term string"))
    found = search.bm25(t, asked, 5, itself).cache()
    got = {(r.query_id, r.rank): (r.id, round(r.score, 6)) for r in search.top(found, ["query_id"], "score", 5).collect()}
    words = {i: [w for w in x.split()] for i, x in texts.items() if x}
    mean = sum(map(len, words.values())) / len(words)
    df = {w: sum(w in x for x in words.values()) for x in words.values() for w in x}
    want = {}
    for q in [i for i in words if i % 50 == 0]:
        scores = []
        for i, x in words.items():
            shared = set(x) & set(words[q])
            if shared and (itself or i != q):
                scores.append((-round(sum(math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * x.count(w) * 2.2 / (x.count(w) + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w in shared), 6), i))
        want |= {(q, n): (i, -s) for n, (s, i) in enumerate(sorted(scores)[:5], 1)}
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-6 for x in want)
    assert found.count() <= 9 * 16 * 2 * 5


def test_word_lists_hold_the_terms_of_a_text(spark, monkeypatch):
    """Texts of one id are one; words that get one number are numbered anew."""
    docs = spark.createDataFrame([(1, "Alpha the ALPHA b-7 É"), (1, "seven b"), (2, "the"), (3, ""), (4, None), (None, "alpha seven")], "id long, text string")
    salts, codes = [], search._codes
    monkeypatch.setattr(search, "_codes", lambda words, salt: codes(words, salt) if salt else codes(words, salt) % 2)
    monkeypatch.setattr(search, "count", lambda: (salts.append(x) or x for x in range(5)))
    word = {int(codes([w], 1)[0]): w for w in ("alpha", "b", "7", "seven")}
    lists = search.word_lists(docs)
    assert salts == [0, 1]
    got = {(r.id, word[c], tf) for r in lists.collect() for c, tf in zip(r.codes, r.tfs)}
    assert got == {(r.id, r.term, r.tf) for r in search.terms(docs.groupBy("id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))).collect()}
    assert {(r.id, r.length) for r in lists.collect()} == {(1, 6.0), (None, 2.0)}
    assert {word[c] for r in search.word_lists(docs, 5).collect() for c in r.codes} == {"alpha", "seven"}


@pytest.mark.parametrize(("common", "cells"), [(0.0, 1 << 24), (0.15, 1 << 24), (0.0, 5000), (2.0, 1 << 24)])
def test_common_words_by_a_matrix_leave_the_same_scores(spark, monkeypatch, common, cells):
    rng = random.Random(9)
    texts = [(i, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(1, 60)))) for i in range(900)]
    lists = search.word_lists(spark.createDataFrame(texts, "id long, text string"))
    asked = search.asked_words(lists, "id % 50 = 0")
    rows = lambda: sorted(map(tuple, search.top(search.best(lists, asked, 4, False), ["query_id"], "score", 4).collect()))
    want = sorted(map(tuple, search.top(search.best(lists, asked, 900, False), ["query_id"], "score", 4).collect()))
    monkeypatch.setattr(search, "FEWEST", 1000)
    monkeypatch.setattr(search, "TOGETHER", 5)
    monkeypatch.setattr(search, "COMMON", common)
    monkeypatch.setattr(search, "CELLS", cells)
    assert rows() == want and len(want) > 60


def test_sharing_hands_on_few_rows(spark, monkeypatch):
    """Of all documents with two words of a query those of the largest values, the least ids first."""
    rng = random.Random(3)
    texts = {i: {f"keyword{rng.randrange(25)}x" for _ in range(rng.randrange(0, 9))} for i in range(400)}
    value = {i: float(i % 7) for i in texts if i % 3}
    lists = search.word_lists(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, text string"), 9)
    values = spark.createDataFrame(list(value.items()), "id long, value double")
    monkeypatch.setattr(search, "FEWEST", 100)
    found = search.sharing(lists.join(values, "id"), search.asked_words(lists, "id % 50 = 0"), 2, 3).cache()
    got = sorted((r.query_id, r.rank, r.id) for r in search.top(found, ["query_id"], "score", 3).collect())
    want = [(q, n, i) for q in range(0, 400, 50) for n, i in enumerate(sorted((i for i in value if i != q and len(texts[i] & texts[q]) >= 2), key=lambda i: (-value[i], i))[:3], 1)]
    assert got == want and want and found.count() <= 8 * 17 * 3
