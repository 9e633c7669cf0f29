"""SimHash components against all pairs, fingerprints against a plain version."""

import random
import re

import numpy as np
import pytest
import xxhash

from mnemospark.llm import simhash
from mnemospark.llm.simhash import cut_bits, drop_near_duplicates, fingerprint, link_components, tables


def plain_fingerprint(text, words=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def brute(rows, distance=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= distance])
    least = {}
    for (doc, _), r in zip(rows, root, strict=True):
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    return sorted(((doc, f"{fp:016x}", least[r]) for (doc, _), fp, r in zip(rows, fps, root, strict=True)), key=str)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 60, 400]))]
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(w.upper() if rng.random() < 0.05 else w for w in copy))
    rng.shuffle(rows)
    return [(1000 + 7 * i % 1009, t) for i, t in enumerate(rows)]


def test_against_all_pairs(spark):
    rows = texts(1, 70) + [(1, None), (2, ""), (3, " \t\n"), (None, "w1 w2 w3 w4"), (5, "W1\x0bw2 w3\x0cw4"), (6, "É é"), (7, "é é"), (8, "x\xa0y z\x1cz"), (9, "dup dup"), (9, "dup dup"), (None, None), (10, "a " * 30_000)]
    docs = spark.createDataFrame([(i, t, 1, b"x", 2, 3) for i, t in rows], "doc_id long, text string, n int, node binary, combo int, held int").repartition(3)
    got = sorted((tuple(r) for r in link_components(docs).collect()), key=str)
    assert got == brute(rows)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _, c in brute(rows) if d is None or d == c)


@pytest.mark.parametrize(("long", "levels"), [(20, 0), (20, 2), (4096, 3)])
def test_clouds_of_fingerprints(spark, monkeypatch, long, levels):
    """Dense clouds (chains, stars, two clouds a bucket apart) against all pairs; buckets over the bound are split or dealt out."""
    monkeypatch.setattr(simhash, "LONG", long)
    monkeypatch.setattr(simhash, "LEVELS", levels)
    rng = random.Random(5)
    fps = set()
    for size, spread in ((300, 3), (300, 6), (40, 2)):
        centre = rng.getrandbits(64)
        for _ in range(size):
            fp = centre
            for b in rng.sample(range(40), rng.randint(0, spread)):
                fp ^= 1 << b
            fps.add(fp)
    at = rng.getrandbits(64)
    for k in range(16):  # a chain of links four bits long
        fps.add(at)
        at ^= 0b1111 << 4 * k
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(200)})
    root = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), len(fps), 4).collect()
    place = {f: i for i, f in enumerate(signed)}
    got = union(len(fps), [(place[r.x], place[r.y]) for r in links])
    assert len(set(zip(root, got, strict=True))) == len(set(root)) == len(set(got))


@pytest.mark.parametrize("size", [1, 2, 31, 32, 33, 700])
def test_buckets(size):
    rng = np.random.default_rng(size)
    fps = np.array([f ^ (1 << int(b)) for f, b in zip(rng.integers(0, 4, size), rng.integers(0, 20, size), strict=True)], np.uint64)
    starts = np.unique(np.r_[0, rng.integers(0, size, 3)])
    starts = starts[starts < size]
    bucket = np.searchsorted(starts, np.arange(size), "right")
    want = union(size, [(i, j) for i in range(size) for j in range(i) if bucket[i] == bucket[j] and int(fps[i] ^ fps[j]).bit_count() <= 2])
    got = union(size, zip(*simhash.bucket_links(starts, fps, 2), strict=True))
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_tables_meet_every_close_pair():
    rng = random.Random(2)
    for nodes in (10, 10**6, 10**8, 10**10):
        masks = tables(nodes, 4)
        for _ in range(300):
            flip = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not flip & m for m in masks)
    assert len(tables(10, 4)) == 5
    assert sum(cut_bits(list(range(64)), 5)) == (1 << 64) - 1


@pytest.mark.parametrize("text", ["", "one", "a b c d e f g", "x " * 20_000, "É é 日本 z\x1cz", "A b\tC\nd e"])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert link_components(docs).count() == 0
    assert drop_near_duplicates(docs).count() == 0
