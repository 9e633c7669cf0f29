"""The divergence audit against a plain version, and the parts of its arithmetic."""

import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest

from mnemospark.llm import divergence as d


def plain(rows, least=3, smoothing=5, top=4):
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", fold(text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == lang]
        docs = Counter(t for x in own for t in set(x[2]))
        kept = sorted(t for t, n in docs.items() if n >= least)
        count = {s: Counter(t for x in own if x[1] == s for t in x[2] if docs[t] >= least) for s in {x[1] for x in own}}
        p = lambda c, t: 1 + 10**9 * (c[t] + smoothing) // (sum(c.values()) + smoothing * len(kept))  # noqa: B023, E731
        everything = sum(count.values(), Counter())
        for s, c in count.items():
            pairs = sorted((-sum(abs(p(c, t) - p(o, t)) for t in kept), i.encode(), i) for i, o in count.items() if i != s)
            found = sorted((p(everything, t) - p(c, t), t.encode(), t) for t in kept if c[t] and p(c, t) > p(everything, t))
            out += [(lang, s, "pair", i, -v, k) for k, (v, _, i) in enumerate(pairs, 1)]
            out += [(lang, s, "term", i, -v, k) for k, (v, _, i) in enumerate(found[:top], 1)]
    return sorted(out)


def made(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["Ab", "ab", "é", "É", "日本", "z`z", "q\x7fq", *[f"w{chr(97 + k)}" for k in range(20)]]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["s0"] * 5 + ["s1", "ß", "S1", None, "s9"])
        text = rng.choice([None, "", "1 2 3"]) if rng.random() < 0.1 else "".join(rng.choice(vocabulary) + rng.choice(" .-9\n") for _ in range(rng.choice([1, 5, 40])))
        rows.append((i, text, lang, source))
    return [*rows, rows[0], (None, "ab", "en", "s0"), (900, "xx yy", "fr", "a"), (901, None, "fr", "b"), (902, "lone", "it", "only"), (903, "wa " * 20_000, "de", "s0")]


@pytest.mark.parametrize("part", [7, d.PART])
def test_against_plain(spark, monkeypatch, part):
    monkeypatch.setattr(d, "PART", part)
    monkeypatch.setattr(d, "HELD_TERMS", 30)
    rows = made(part % 5)
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, source string, n int, term string, whole int").repartition(4)
    got = d.divergence(docs, least_docs=3, top=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert d.divergence(docs).count() == 0


def test_gallop():
    rng = np.random.default_rng(3)
    for n, m in product((0, 1, 255, 256, 257, 3000), (0, 1, 300, 70_000)):
        small, large = np.unique(rng.integers(0, 100_000, n)), np.unique(rng.integers(0, 100_000, m))
        assert (d.gallop(small, large) == np.searchsorted(large, small)).all()


def test_shares_are_exact():
    counts = np.array([0, 1, 7, 10**12, 9 * 10**14])
    whole = 9 * 10**14 + 12345
    assert d.shares(counts, 5, whole).tolist() == [1 + 10**9 * (int(c) + 5) // whole for c in counts]
    with pytest.raises(OverflowError):
        d.shares(counts, 5, 10**16)
