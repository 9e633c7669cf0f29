"""The encoder against the tokenizers library on whole code-point ranges and the driver's texts."""

import json
import zlib

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mnemospark.llm.bpe import WordBpe, encode
from mnemospark.llm.token_shards import training_order

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return WordBpe(PATH), Tokenizer.from_file(PATH)


def same(both, texts):
    own, lib = both
    expected = lib.encode_batch(texts, add_special_tokens=False)
    for text, ids, e in zip(texts, own.encode_batch(texts), expected, strict=True):
        assert ids.tolist() == e.ids, repr(text)
        assert own.decode(ids) == lib.decode(e.ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """The vocabulary with all ids moved up by 30000 unused ones, so that many pass 16 bits."""
    held = json.load(open(PATH))
    held["model"]["vocab"] = {f"unused {i}": i for i in range(30_000)} | {t: i + 30_000 for t, i in held["model"]["vocab"].items()}
    for token in held["added_tokens"]:
        token["id"] += 30_000
    path = tmp_path_factory.mktemp("wide") / "wide.json"
    path.write_text(json.dumps(held))
    return str(path)


def test_ids_of_over_16_bits(both, wide, spark):
    own, lib = WordBpe(wide), Tokenizer.from_file(wide)
    texts = [*pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist(), "x<|endoftext|>Y", ""]
    found = own.encode_batch(texts)
    assert max(x.max(initial=0) for x in found) > 1 << 16
    for text, x, y, e in zip(texts, found, both[0].encode_batch(texts), lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert x.tolist() == e.ids and x.tolist() == (y.astype(int) + 30_000).tolist()
        assert own.decode(x) == both[0].decode(y), text
    docs = spark.createDataFrame(list(enumerate(texts[:50])), "doc_id long, text string")
    assert {r.doc_id: r.ids for r in encode(docs, wide).collect()} == {i: x.tolist() for i, x in enumerate(found[:50])}
    slots = training_order(docs, wide, key=3, token_bytes=4).collect()
    ids = {i: [*x.tolist(), own.special["<|endoftext|>"]] for i, x in enumerate(found[:50])}
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in slots} == {(i, k): zlib.crc32(np.array(x[256 * k : 256 * k + 256], "<u4").tobytes()) for i, x in ids.items() for k in range(-(-len(x) // 256))}
    with pytest.raises(Exception, match="do not fit 2 bytes"):
        training_order(docs, wide, key=3).collect()


def test_driver_texts(both):
    same(both, pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist())


def test_special_cases(both):
    same(both, ["", " ", "\x1ca\x1fb", "a\x85b\xa0c d", "I'll don't 'S 'VE", "x<|endoftext|>Y <|startoftext|>", "<|EndOfText|>",
                "ΑΣ ΣΑΣ", "İİ", "é É", "aaaa" * 500, "日本語テキスト 123४५", "​﻿", "a_b-c!!?", "ǅ ﬁ ½ Ⅷ ²"])


def test_every_basic_code_point(both):
    chars = [chr(c) for c in (*range(0x3400), *range(0xA000, 0x11000), *range(0x1E900, 0x1F700)) if not 0xD800 <= c < 0xE000]
    same(both, ["a" + c + "b " + c + c for c in chars])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x24F), max_size=60), min_size=1, max_size=8))
def test_random_texts(both, texts):
    same(both, texts)


def test_a_word_that_pieces_share_is_merged_once(monkeypatch):
    """op7_token_shards passed its CPU limit: each piece of a batch was looked up twice, and its words merged anew."""
    from mnemospark.llm import bpe

    own, merged, plain = WordBpe(PATH), [], WordBpe.merge
    monkeypatch.setattr(WordBpe, "merge", lambda self, symbols, word: merged.append(len(symbols)) or plain(self, symbols, word))
    own.encode_batch(["(wonder, wonder! wonder? wonder", "Wonder wonder wonder.\xa0wonder"])
    assert sum(merged) == len("wonder" + "(,!?.")
    own.encode_batch(["wonder WONDER\x85wonder."])
    assert len(merged) == 1
    monkeypatch.setattr(bpe, "MEMO_PIECES", 6)  # full: what the batch asks for is kept, only what is new is merged
    texts = ["wonder wonder. wander under"]
    assert [x.tolist() for x in own.encode_batch(texts)] == [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert merged[1:] == [len("wanderunder")]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "É", "e\u0301", "ş", "Σ", "日本", "\u3000", "\xa0", "\x85", "\x1c", "\x0b", "\x0c", "\r\n", "\n", " ", "'ll", "7", "½", "!?", "<|", "|>", "<|endoftext|>", "\0", "\u0250", "\u024f", "😀"]), max_size=20).map("".join), min_size=1, max_size=6))
def test_mixed_spaces_and_scripts(both, texts):
    same(both, texts)


def test_merge_of_runs(both):
    own, _ = both
    assert isinstance(own.encode_batch(["a" * 5000])[0], np.ndarray)
    same(both, ["a" * n for n in range(1, 40)] + ["ha" * n for n in range(1, 40)])


def test_operators_on_spark(spark):
    """Nulls, empty and very long texts, repeats, an empty table, clashing columns; ids beside nulls keep their last digits."""
    import hashlib

    from mnemospark.llm.bpe import decode, encode, round_trip

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = [(1, "Héllo  wörld!"), (2, ""), (None, None), (2**60 + 1, "x" * 3000 + " end"), (5, "same same"), (5, "same same"), (6, "word " * 20_000)]
    docs = spark.createDataFrame([(i, t, [7], "clash") for i, t in texts], "doc_id long, text string, ids array<int>, decoded_sha256 string").coalesce(1)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i] = (ids, lib.decode(ids, skip_special_tokens=False))
    got = round_trip(docs, path).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in texts)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want[r.doc_id][0]), sha(" ".join(map(str, want[r.doc_id][0]))), sha(want[r.doc_id][1])) for r in got)
    encoded = encode(docs, path)
    assert all(list(r.ids) == want[r.doc_id][0] for r in encoded.collect())
    assert all(r.text == want[r.doc_id][1] for r in decode(encoded, path).collect())
    assert round_trip(docs.limit(0), path).collect() == encode(docs.limit(0), path).collect() == []
