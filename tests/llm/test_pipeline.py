"""Each stage of the pipeline on what its predecessor kept, against plain versions."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from mnemospark.llm._common import documents, materialise


@pytest.fixture(scope="module")
def kept(spark):
    """Planted cases beside the driver's documents, and every stage's output."""
    rng = random.Random(9)
    base = documents(spark, "/root/testdata/sf0.01")
    words = [w for t in base.where("lang = 'en'").limit(40).toPandas().text for w in t.split() if w.isalpha() and w.isascii()]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, article = text(80), text(200)
    near = article.split()
    near[100] = "changed"
    planted = {
        90001: "12 34 !!", 90002: "", 90003: None,
        90010: article, 90011: article.upper(), 90012: " ".join(near),
        90020: text(60) + " " + passage + " " + text(50), 90021: text(70) + " " + passage + " " + text(40),
        90030: text(150),
    }
    docs = base.unionByName(spark.createDataFrame([(i, t, "en", "planted", len(t or "")) for i, t in planted.items()], base.schema))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], "/root/testdata/sf0.01"), name))
    return planted, passage, out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").distinct().collect())


def test_columns_and_order(kept):
    _, _, out = kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]
    assert all(df.columns == out[0].columns for df in out[:-1])
    assert "sequence_id" in out[-1].columns


def test_decisions_on_planted_cases(kept):
    planted, passage, out = kept
    stage = [set(ids(df)) for df in out]
    assert {90001, 90002, 90003} & stage[1] == set() and len(stage[0] - stage[1]) <= 10
    assert 90011 in stage[2] and 90010 not in stage[2]
    assert {90011, 90012} <= stage[2] and not {90010} & stage[2]
    assert {90020, 90021, 90030} <= stage[4]
    texts = {r.doc_id: r.text for r in out[4].collect()}
    assert texts[90030] == planted[90030] and texts[90020] == planted[90020]
    assert passage not in " ".join(texts[90021].split()) and len(texts[90021].split()) == 110


def test_exact_and_near_stages_against_plain_versions(kept):
    _, _, out = kept
    groups = defaultdict(list)
    for r in out[1].collect():
        groups["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text)].append(r.doc_id)
    assert ids(out[2]) == sorted(max(g) for g in groups.values())
    rows = [(r.doc_id, r.text) for r in out[2].collect()]
    sets, by_shingle = {}, defaultdict(list)
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
        for s in sets[i]:
            by_shingle[s].append(i)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for j in by_shingle[x]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert ids(out[3]) == sorted(i for i in sets if find(i) == i)


def test_packing_holds_every_document(kept):
    _, _, out = kept
    assert ids(out[5]) == ids(out[4])
