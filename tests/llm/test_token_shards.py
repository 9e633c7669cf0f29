"""The permutation is one, slots are its images, and shards hold every document's tokens."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mnemospark.llm.token_shards import END_TOKEN, Feistel, read_shard, read_shards, sequences, training_order, write_shards
from mnemospark.storage import shared_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 2**64 - 1))
def test_feistel_permutes_any_domain(domain, key):
    f = Feistel(domain, key)
    out = f.permute(np.arange(domain))
    assert sorted(out.tolist()) == list(range(domain))
    assert f.invert(out).tolist() == list(range(domain))


def test_feistel_large_domain_and_keys():
    f = Feistel(2**62, 5)
    x = np.array([0, 1, 2**62 - 1, 12345678901234], np.uint64)
    assert (f.invert(f.permute(x)) == x).all()
    assert not np.array_equal(Feistel(1000, 1).permute(np.arange(1000)), Feistel(1000, 2).permute(np.arange(1000)))
    corr = np.corrcoef(np.arange(10000), Feistel(10000, 3).permute(np.arange(10000)).astype(float))[0, 1]
    assert abs(corr) < 0.05
    with pytest.raises(ValueError):
        Feistel(0, 1)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    rows = training_order(docs, PATH, key=7, tokens=64, shard_bytes=50_000).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) == sorted(r.number for r in rows)
    images = Feistel(len(rows), 7).permute(np.array([r.number for r in rows]))
    assert images.tolist() == [r.slot for r in rows]  # the slot is the image of the number, and nothing else
    ordered = sorted(rows, key=lambda r: r.slot)
    sizes = [sum(r.shard == k for r in rows) for k in range(ordered[-1].shard + 1)]
    assert len(sizes) > 3 and len(set(sizes[:-1])) == 1 and 0 < sizes[-1] <= sizes[0]
    assert all(r.shard == r.slot // sizes[0] for r in rows)
    lib = Tokenizer.from_file(PATH)
    end = lib.token_to_id(END_TOKEN)
    by_doc = defaultdict(dict)
    for r in rows:
        by_doc[r.doc_id][r.piece] = (r.length, r.ids_crc32)
    for d in docs.collect():
        ids = [*lib.encode(d.text, add_special_tokens=False).ids, end]
        cuts = [np.array(ids[k : k + 64], "<u4") for k in range(0, len(ids), 64)]
        assert by_doc[d.doc_id] == {k: (len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(cuts)}
    assert {(r.doc_id, r.piece): r.slot for r in rows} != {(r.doc_id, r.piece): r.slot for r in training_order(docs, PATH, key=8, tokens=64, shard_bytes=50_000).collect()}


def test_resume_and_strides(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    order = sequences(docs, PATH, 1, 128)
    manifest = write_shards(order, shared_path(spark, "shards"), 128, 30_000)
    whole = sorted(read_shards(manifest).collect())
    assert len(whole) == order.sequences
    for start in (0, 1, 100, len(whole) - 1, len(whole)):
        assert sorted(read_shards(manifest, start).collect()) == whole[start:]
    again = write_shards(order, shared_path(spark, "shards"), 128, 30_000)  # the same stored sequences: the same order
    assert sorted(read_shards(again).collect()) == whole
    m = manifest.orderBy("shard").first()
    blocks = np.concatenate(list(read_shard(m.file)))
    assert len(blocks) == m.records and np.concatenate(list(read_shard(m.file, 5))).tobytes() == blocks[5:].tobytes()
    k = whole[77]  # a slot's place, by arithmetic alone
    record = next(read_shard({r.shard: r.file for r in manifest.collect()}[k.slot // m.records], k.slot % m.records))[0]
    assert (record["slot"], record["doc_id"], record["piece"]) == (77, k.doc_id, k.piece)
    assert order.feistel.invert(np.array([77]))[0] == k.number


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "one two"), (None, "one two"), (2**62, "far"), (2**60 + 1, "odd"), (-(2**62), "away"), (4, "same"), (4, "same"), (5, "w " * 3000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int").repartition(3)
    got = training_order(docs, PATH, 3, 16, 1000).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    assert sum(r.length for r in got if r.doc_id == 4) == 4 and sum(r.length for r in got if r.doc_id is None) == 6
    assert training_order(docs.limit(0), PATH, 3).collect() == []
    with pytest.raises(Exception, match="do not fit"):
        training_order(docs, PATH, 3, token_bytes=1).collect()


def test_hot_id_spreads(spark):
    """A third of all rows under one id, or none, lie all over the slots."""
    docs = spark.createDataFrame([(7 if k % 3 else None, "x y") for k in range(3000)], "doc_id long, text string")
    got = training_order(docs, PATH, 5, 16, 1000).collect()
    assert abs(np.mean([r.slot for r in got if r.doc_id is None]) - 1500) < 100
