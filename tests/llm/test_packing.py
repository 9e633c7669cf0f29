"""Packing: pieces against the tokenizers library, sequences gapless and within capacity, near the lower bound."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mnemospark.llm.packing import best_fit, fit_counts, pack, patterns, plan

PATH = public_tokenizers.path("word_bpe_49k.json")


def checked(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    assert sorted(sequences) == list(range(len(sequences)))
    return len(sequences)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pack(docs, PATH).collect()
    n = checked(rows, 2048)
    assert n <= 1.01 * -(-sum(r.length for r in rows) // 2048) + 1
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    lib = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for doc, text in texts.items():
        ids = [*lib.encode(text, add_special_tokens=False).ids, 0]
        got = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(-(-len(ids) // 2048)))
        for r in got:
            cut = ids[2048 * r.piece : 2048 * (r.piece + 1)]
            assert (r.start, r.length) == (2048 * r.piece, len(cut))
            assert r.ids_crc32 == zlib.crc32(np.array(cut, "<u4").tobytes())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "one two"), (3, "w " * 9000), (4, "same"), (4, "same")] + [(k, "hot text here") for k in range(10, 200)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, length int, rank int").repartition(3)
    got = pack(docs, PATH, capacity=16, with_ids=True).collect()
    checked(got, 16)
    assert len({r.doc_id for r in got}) == len({i for i, _ in rows})
    assert sum(r.length for r in got if r.doc_id == 4) == 4
    assert all(len(r.ids) == r.length for r in got)
    assert pack(docs.limit(0), PATH).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=40))
def test_plans_place_every_rank_once(histogram):
    p = plan(histogram, 64)
    sequences = defaultdict(list)
    for length, n in histogram.items():
        s, o = p.place(np.full(n, length), np.arange(n))
        for a, b in zip(s.tolist(), o.tolist(), strict=True):
            sequences[a].append((b, length))
    assert len(sequences) == p.sequences
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64


def test_fit_is_least_squares():
    counts = np.zeros(65, np.int64)
    counts[[64, 40, 24, 20, 22, 2]] = [5, 30, 40, 10, 10, 5]
    table = patterns(64, counts)
    x = fit_counts(table, counts, sweeps=5000)
    a = np.zeros((65, len(table)))
    for j, row in enumerate(table):
        for n in row[row > 0]:
            a[n, j] += 1
    gradient = a.T @ (a @ x - counts)
    assert (x >= 0).all() and (gradient > -1.5).all() and np.abs(gradient[x > 0.01]).max() < 1.5


def test_best_fit_against_item_by_item():
    rng = np.random.default_rng(3)
    items = sorted(rng.integers(1, 50, 300).tolist(), reverse=True)
    bins = []
    for n in items:
        fits = [b for b in bins if b >= n]
        if fits:
            b = min(fits)
            bins.remove(b)
            bins.append(b - n)
        else:
            bins.append(64 - n)
    lengths, times = np.unique(items, return_counts=True)
    got = sum(n for n, _ in best_fit(dict(zip(lengths.tolist(), times.tolist(), strict=True)), 64))
    assert got <= len(bins) + 1


@pytest.mark.parametrize("n", [20_000])
def test_large_histogram_is_near_its_bound(n):
    lengths = np.clip(np.random.default_rng(5).lognormal(6.2, 0.9, n), 1, 2048).astype(int)
    values, times = np.unique(lengths, return_counts=True)
    p = plan(dict(zip(values.tolist(), times.tolist(), strict=True)))
    assert p.fitted > 0 and p.sequences <= 1.002 * -(-lengths.sum() // 2048) + 1
