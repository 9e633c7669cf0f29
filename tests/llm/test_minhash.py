"""Link components against all pairs, and the parts of the signature."""

import random
import re

import numpy as np
import pytest

from mnemospark.llm.minhash import Shingler, _permute, banding, drop_near_duplicates, link_components, parity_sketch, signature


def shingles(text, words):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return set()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or {tuple(w)}


def brute(rows, words, threshold):
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and threshold[1] * len(a & b) >= threshold[0] * len(a | b):
                parent[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if sets[i] else [doc]
        least = min(ids, default=None)
        out.append((doc, len(sets[i]), least, doc == least))
    return sorted(out, key=str)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 30, 120]))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(w.upper() if rng.random() < 0.05 else w for w in copy))
    rng.shuffle(rows)
    return [(100 + 7 * i % 1009, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("words", "threshold"), [(3, (85, 100)), (5, (80, 100))])
def test_against_all_pairs(spark, words, threshold):
    rows = texts(words, 60) + [(1, None), (2, ""), (3, " \t\n"), (None, "w1 w2 w3 w4"), (5, "w1 w2 w3 w4"), (6, "É é"), (7, "é é"), (8, "x\xa0y z"), (9, "dup dup"), (9, "dup dup")]
    docs = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, n int, node binary").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in link_components(docs, words, threshold).collect()), key=str)
    assert got == brute(rows, words, threshold)


def test_group_of_borderline_copies(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(150):
        copy = list(base)
        for k in rng.sample(range(150), rng.randrange(1, 6)):
            copy[k] = f"x{i}_{k}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in link_components(docs, 3, (85, 100)).collect()), key=str)
    assert got == brute(rows, 3, (85, 100))


def test_empty_and_filter(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, kept string")
    assert link_components(docs).collect() == []
    docs = spark.createDataFrame([(3, "a b c d e f", "k"), (2, "A b c d e f", "k"), (None, None, None), (4, "", None)], "doc_id long, text string, kept string")
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4", "None"]


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate((a[:900], rng.integers(0, 2**63, 100).astype(np.uint64)))
    x, y = signature(a, 125), signature(b, 125)
    assert abs((x == y).mean() - 900 / 1100) < 0.12
    assert len(np.unique(_permute(np.arange(1 << 16, dtype=np.uint32)))) == 1 << 16
    differ = sum((int(p) ^ int(q)).bit_count() if (int(p) ^ int(q)) >= 0 else 64 - (~(int(p) ^ int(q))).bit_count() for p, q in zip(parity_sketch(a), parity_sketch(b), strict=True))
    assert 150 < differ <= 200
    assert banding(0.85) == (5, 25) and banding(0.8) == (4, 32)


def test_shingler_matches_definition():
    s = Shingler(3)
    for t in ["", "a", "a b", "a b c", "a b c a b c a", "A\x0bb\x0cC d", "x\x1cy z w", "é É b c"]:
        assert len(s(t)) == len(shingles(t, 3))
    assert (s("A b C d") == s("a B c D")).all()
