"""Collocations against a plain version; transducers against dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from mnemospark.llm import collocations as c


def plain(rows, least, top):
    fold = lambda t: "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t)
    out = []
    for lang in {r[1] or "und" for r in rows}:
        f = Counter()
        for text, own in rows:
            if (own or "und") == lang:
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(text or "")):
                    w = re.findall(r"[^\x20\x09]+", piece)
                    f.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
        n = sum(v for x, v in f.items() if len(x) == 1)
        found = {x: v for x, v in f.items() if v >= least and len(x) > 1}
        within = lambda x, y: len(x) < len(y) and any(y[i : i + len(x)] == x for i in range(len(y)))
        scored = []
        for x, a in found.items():
            if not any(within(x, y) and 100 * b >= 80 * a for y, b in found.items()):
                score, k = min((2000000 * a // (f[x[:k]] + f[x[k:]]), k) for k in range(1, len(x)))
                scored.append((-score, -a, " ".join(x).encode(), f[x[:k]], f[x[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "é", "É", "日本", "-", "a\x00b", "new", "york", "city", "times", *[f"w{k}" for k in range(12)]]
    rows = []
    for _ in range(120):
        text = ""
        for _ in range(rng.choice([0, 1, 2, 30])):
            text += rng.choice(["new york city", "New York", "city times", rng.choice(vocabulary), "aa aa aa aa aa aa"]) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"])
        rows.append((text, rng.choice(["en", "en", "de", None])))
    return [*rows, (None, "en"), (None, None), ("lone", "fr"), ("x y z", "it"), ("the cat " * 5000, "en"), rows[3]]


@pytest.mark.parametrize(("shard", "waiting", "pairs"), [(300, 2, 5), (2_500_000, 32, 4000)])
def test_against_plain(spark, monkeypatch, shard, waiting, pairs):
    monkeypatch.setattr(c, "WAITING", waiting)
    monkeypatch.setattr(c, "RANGE_PAIRS", pairs)
    rows = made(shard)
    docs = spark.createDataFrame([(1, *r, 2, "x", 3) for r in rows], "doc_id long, text string, lang string, n int, phrase string, hash int").repartition(4)
    for top in (7, 2000):
        got = c.collocations(docs, least=6, top=top, shard_words=shard)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == plain(rows, 6, top)


def test_full_filters_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(c, "FILTER_BITS", 6)
    rows = made(9)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, c.collocations(docs, least=6).collect())) == plain(rows, 6, 2000)


def test_empty(spark):
    assert c.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_transducers(seed):
    rng = random.Random(seed)
    made = [Counter({tuple(rng.choice([b"a", b"b", b"\xc3\xa9", b"dd"]) for _ in range(rng.randint(1, 4))): rng.choice([1, 1, 2, 10**12]) for _ in range(rng.choice([0, 1, 60]))}) for _ in range(4)]
    built = [c.Transducer.from_bytes(c.Transducer.build(sorted(m.items())).to_bytes()) for m in made]
    for m, t in zip(made, built, strict=True):
        assert list(t.items()) == sorted(m.items())
    whole = sum(made, Counter())
    assert list(c.unite(built).items()) == sorted(whole.items())
    assert sorted(built[0].compose(built[1])) == sorted((x, n, made[1][x]) for x, n in made[0].items() if x in made[1])


@pytest.mark.parametrize("seed", range(4))
def test_shards_from_rows(seed):
    rng = np.random.default_rng(seed)
    names = [b"a", b"b", b"dd", b"\xc3\xa9"]
    grams = {tuple(g[: k + 1]) for g in rng.integers(1, 5, (30, 4)).tolist() for k in range(rng.integers(1, 5))} | {(2,)}
    held = {g: int(rng.integers(5, 10**12)) // 10 ** len(g) for g in grams if len(g) > 1 or g[0] % 2 or rng.random() < 0.5}
    rows = np.array(sorted([*g, *[0] * (4 - len(g))] for g in held), np.int64)
    t = c.Transducer.of_rows(names, rows, np.array([held[tuple(x for x in r if x)] for r in rows.tolist()], np.int64))
    assert list(c.Transducer.from_bytes(t.to_bytes()).items()) == sorted((tuple(names[i - 1] for i in g), n) for g, n in held.items())


def test_equal_tails_are_one_state():
    grams = sorted({(a, b, d): 5 for a in (b"x", b"y", b"z") for b in (b"p", b"q") for d in (b"r", b"s")}.items())
    assert len(c.Transducer.build(grams).own) == 4  # root, after one word, after two, the end
