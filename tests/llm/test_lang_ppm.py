"""Code lengths against a plain recursive PPM, and accuracy on held-out documents."""

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from mnemospark.llm import lang_ppm
from mnemospark.llm.lang_ppm import MAX_ORDER, PpmModel, _count, fit, folded, identify, keep_identified

TRAIN = {"de": ["die Katze schläft und die Sonne scheint", "Straße"], "en": ["the cat sleeps and the sun shines", "a street"]}


def model():
    langs = sorted(TRAIN)
    frame = pd.DataFrame([(langs.index(k), t) for k, ts in TRAIN.items() for t in ts], columns=["lang", "text"])
    return PpmModel(langs, pd.concat(_count(iter([frame]))).groupby(["lang", "ord", "key"], as_index=False).n.sum())


def plain_bits(lang, text):
    counts = [Counter() for _ in range(MAX_ORDER + 1)]
    for t in TRAIN[lang]:
        data = b" " * MAX_ORDER + folded(t)
        for i in range(MAX_ORDER, len(data)):
            for k in range(MAX_ORDER + 1):
                counts[k][data[i - k : i + 1]] += 1
    data, bits = b" " * MAX_ORDER + folded(text), 0.0
    for i in range(MAX_ORDER, len(data)):
        for k in range(MAX_ORDER, -1, -1):
            context = data[i - k : i]
            after = {g[-1]: n for g, n in counts[k].items() if g[:-1] == context}
            if not after:
                continue
            total = sum(after.values()) + len(after)
            if data[i] in after:
                bits -= math.log2(after[data[i]] / total)
                break
            bits -= math.log2(len(after) / total)
        else:
            bits += 8
    return bits


def test_exact_code_lengths():
    m = model()
    texts = ["the cat", "die Straße", "xyz qqq 12!", "", "Katze and the", "日本", "a" * 300]
    got = m.lengths([folded(t) for t in texts]) / lang_ppm.UNIT
    for i, t in enumerate(texts):
        for k, lang in enumerate(m.langs):
            assert abs(got[i, k] - plain_bits(lang, t)) < 1e-4 * max(1, len(t.encode()))


def test_undetermined():
    m = model()
    assert [p[:2] for p in m.predict([None, "", "123 !", "the cat"])][:3] == [("und", 0.0)] * 3
    assert m.predict(["the cat sleeps"])[0][0] == "en"
    assert PpmModel([], pd.DataFrame({"lang": [], "ord": [], "key": [], "n": []}, dtype="int64")).predict(["abc"])[0][0] == "und"


def test_documents_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in out]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows_and_filter(spark):
    rows = [(i, "the cat sleeps and the sun shines", "en", "x") for i in range(20)] + [(None, None, None, None), (50, "", "en", "x"), (51, "12 34", "zz", "x"), (52, "the " * 100000, None, "x"), (52, "the cat", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = identify(docs).collect()
    assert len(got) == len(rows)
    kept = keep_identified(docs)
    assert kept.columns == docs.columns
    assert kept.count() == 22
    empty = spark.createDataFrame([], docs.schema)
    assert identify(empty).collect() == [] and keep_identified(empty).collect() == []


def test_sample_bound(spark):
    rows = [(i, "word " * 40, "en") for i in range(2000)]
    m = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_bytes=20_000)
    assert m.langs == ["en"]


SCHEMA = "doc_id long, text string, lang string"


def sampled(monkeypatch, spark, rows, train_bytes):
    """Bytes that order 0 of the fitted model has seen."""
    seen = []
    monkeypatch.setattr(lang_ppm, "PpmModel", lambda langs, counts: seen.append(counts) or PpmModel(langs, counts))
    fit(spark.createDataFrame(rows, SCHEMA), train_bytes=train_bytes)
    return sum(int(c[c.ord == 0].n.sum()) for c in seen)


def test_long_rows_are_learned(spark):
    greek = "η γάτα κοιμάται και ο ήλιος λάμπει πάνω από τη θάλασσα "
    rows = [(i, "the cat sleeps and the sun shines " * 2, "en") for i in range(60)] + [(100 + i, greek * 400, "el") for i in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert fit(docs, train_bytes=4000).langs == ["el", "en"]
    found = lang_ppm.predict(docs, fit(docs, train_bytes=4000)).collect()
    assert all(not r.rejected and r.lang_pred == ("el" if r.doc_id >= 100 else "en") for r in found)


def test_short_rows_that_do_not_fill_the_sample_are_joined_by_pieces(monkeypatch, spark):
    rows = [(1, "kurz", "de")] + [(i, f"die Katze {i} schläft und die Sonne scheint " * 100, "de") for i in range(10, 20)]
    assert 1000 < sampled(monkeypatch, spark, rows, 4000) <= 4000


def test_null_and_repeated_ids_keep_the_bound(monkeypatch, spark):
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)]
    for same in (None, 8):
        assert 1000 < sampled(monkeypatch, spark, [(same, w * 10, "en") for w in words], 8000) <= 8000
    assert 0 < sampled(monkeypatch, spark, [(None, "the same text", "en")] * 3000, 8000) <= 8000


def test_first_level_over_the_bound(monkeypatch, spark):
    rows = spark.range(400).selectExpr("id AS doc_id", "'word word ' AS text", "'en' AS lang")
    level0 = rows.where("shiftrightunsigned(xxhash64(doc_id, text), 62) >= 2 AND shiftrightunsigned(xxhash64(doc_id), 62) >= 2").collect()
    assert len(level0) > 50
    assert 0 < sampled(monkeypatch, spark, level0, 80) <= 80


def test_more_languages_than_a_group(monkeypatch, spark):
    rows = [(9 * k + i, f"{a}{b}{a} {b}{b}{a} " * 5, f"{a}{b}") for k, (a, b) in enumerate((a, b) for a in "abcdefghijklmnopqr" for b in "abcdefghijklmnopqr") for i in range(9)]
    m = fit(spark.createDataFrame(rows, SCHEMA), train_bytes=2000)
    assert len(m.langs) == 324
    texts = {r[2]: r[1] for r in rows}
    assert [p[0] for p in m.predict([texts[x] for x in m.langs])] == m.langs
    monkeypatch.setattr(lang_ppm, "GROUP_LANGUAGES", 1000, raising=False)
    one = fit(spark.createDataFrame(rows, SCHEMA), train_bytes=2000)
    data = [folded(t) for t in list(texts.values())[:20]]
    assert np.abs(one.lengths(data) - m.lengths(data)).max() <= 100
