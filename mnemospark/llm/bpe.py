"""Byte-pair encoding by batched numpy merge rounds, and decoding.

The symbols of many words lie in one flat array. A round looks up the rank of
every pair of neighbours by binary search over the sorted pair keys, finds the
lowest rank of each word, and merges all its occurrences in all words at once;
words without a pair that merges leave the array. Only pairs beside a merge
are looked up anew in the next round.

Pieces of text between white space are independent under this family of
tokenizers (the splitting pattern never crosses white space). Arrow splits a
group of texts and numbers its distinct pieces, so a piece is looked up once a
group; each task encodes those it has not met and keeps a bounded memo of them.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm._common import text_id, trimmed, whole_ids

#: Pieces that a task's memo holds at most.
MEMO_PIECES = 400_000
#: Texts are encoded in groups of at least this many characters.
GROUP_CHARS = 4 << 20
_NONE = np.int32(0x7FFFFFFF)
#: Beyond this range, letters and cases depend on a library's Unicode version, so the tokenizers library decides.
_RARE = regex.compile("[^\0-\u024f]")


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _held(binary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each value of a fresh (unsliced) large binary array begins, the end of the last, and the bytes of all."""
    return np.frombuffer(binary.buffers()[1], np.int64, len(binary) + 1), np.frombuffer(binary.buffers()[2] or b"", np.uint8)


class WordBpe:
    """Encoder and decoder of a tokenizers file: lower-casing byte-level BPE with a word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = regex.compile(split["pattern"]["Regex"] + r"|\n")
        self._split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self._normaliser = tokenizers.Tokenizer.from_file(path).normalizer
        chars = _byte_chars()
        self._inner = np.array([vocab[c] for c in chars], np.int32)
        self._final = np.array([vocab[c + self.suffix] for c in chars], np.int32)
        self.tokens: list[str] = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self._decimal = [str(i) for i in range(len(self.tokens))]
        self.kind = np.dtype("<u2" if len(self.tokens) <= 1 << 16 else "<u4")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        # A merge never makes a pair of lower rank, so all occurrences of the lowest pair can merge at once.
        born = np.full(len(self.tokens), -1, np.int64)
        np.minimum.at(first := np.full(len(self.tokens), len(merges), np.int64), made, np.arange(len(merges)))
        born[made] = first[made]
        if (np.maximum(born[left], born[right]) >= np.arange(len(merges))).any():
            raise ValueError(f"{path}: a merge comes before its parts")
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self._keys, self._rank, self._made = keys[order], order.astype(np.int32), made
        self._memo = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair by binary search; _NONE where the pair doesn't merge."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self._keys, keys)
        at[at == len(self._keys)] = 0
        return np.where(self._keys[at] == keys, self._rank[at], _NONE)

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over the flat symbols of many words; word: the (sorted) word of each symbol."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        same = np.empty(len(word), bool)
        same[-1:] = False
        same[:-1] = word[:-1] == word[1:]
        rank = np.full(len(word), _NONE, np.int32)
        inside = np.flatnonzero(same)
        rank[inside] = self._ranks(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(word)))
            each = np.repeat(lowest, sizes)
            live = each != _NONE
            if not live.all():
                done.append((word[~live], symbols[~live]))
                word, symbols, rank, each = word[live], symbols[live], rank[live], each[live]
                if not len(word):
                    break
            hit = rank == each
            at = np.flatnonzero(hit)
            follows = np.concatenate(([False], at[1:] == at[:-1] + 1))
            if follows.any():  # a run of one symbol: from the left, every second pair
                k = np.arange(len(at))
                at = at[(k - np.maximum.accumulate(np.where(follows, 0, k))) % 2 == 0]
            symbols[at] = self._made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            new = place[at]
            touched = np.concatenate((new, new[new > 0] - 1))
            pair = touched + 1 < len(word)
            rank[touched[~pair]] = _NONE
            touched = touched[pair]
            rank[touched] = np.where(word[touched] == word[touched + 1], self._ranks(symbols[touched], symbols[touched + 1]), _NONE)
        if not done:
            return word, symbols
        word, symbols = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(word, kind="stable")
        return word[order], symbols[order]

    def _encode_words(self, words: pa.Array) -> pa.Array:
        """The ids (in bytes) of distinct words; a line feed stands between pieces and has none."""
        starts = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)
        flat = np.frombuffer(words.buffers()[2] or b"", np.uint8, int(starts[-1]))
        word = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(starts))
        symbols = self._inner[flat]
        symbols[starts[1:] - 1] = self._final[flat[starts[1:] - 1]]
        real = flat != 10
        of, ids = self.merge(symbols[real], word[real])
        cuts = np.searchsorted(of, np.arange(len(words) + 1)) * self.kind.itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(ids.astype(self.kind))])

    def _encode_pieces(self, pieces: pa.Array) -> pa.Array:
        """The ids (in bytes) of normalised pieces that hold no white space; a word that many pieces share is merged once."""
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(pieces)], pieces), pa.scalar("\n", pieces.type))[0].as_py()
        rare = self._rare(text)
        found = self._words.findall(text) if len(rare) < len(pieces) else []
        if rare:
            of_piece: list[list[str]] = [[]]
            for w in found:
                of_piece[-1].append(w) if w != "\n" else of_piece.append([])
            of_piece += [[] for _ in range(len(pieces) - len(of_piece))]
            for i in rare:
                of_piece[i] = [w for w, _ in self._split.pre_tokenize_str(pieces[i].as_py())]
            found = [w for i, p in enumerate(of_piece) for w in (["\n", *p] if i else p)]
        words = pa.array(found, pa.large_string()).dictionary_encode()
        ids = self._encode_words(words.dictionary).take(words.indices)
        starts, _ = _held(ids)
        line = np.flatnonzero(words.indices.to_numpy() == words.dictionary.index("\n").as_py())
        cuts = np.concatenate(([0], starts[line], starts[-1:]))
        return pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(cuts), ids.buffers()[2]])

    def _rare(self, text: str) -> list[int]:
        """Which of the pieces that line feeds part hold a character past the range of _RARE: from its first byte C9 90 on."""
        if text.isascii():
            return []
        flat = np.frombuffer(text.encode(), np.uint8)
        at = np.flatnonzero((flat > 0xC9) | (flat == 0xC9) & (np.append(flat[1:], np.uint8(0)) > 0x8F))
        return np.unique(np.searchsorted(np.flatnonzero(flat == 10), at)).tolist()

    def _normalise(self, text: str) -> str:
        """Normalised text; its white space is ASCII only."""
        if not text.isascii():
            if _RARE.search(text):
                return self._normaliser.normalize_str(text)
            text = unicodedata.normalize("NFC", text).replace("\x85", " ").replace("\xa0", " ")
        return text.lower()

    def _parts(self, text: str) -> list[str | int]:
        """Normalised text between special tokens, and the ids of those."""
        if self._special is not None and "<|" in text and self._special.search(text):
            return [self.special[p] if p in self.special else self._normalise(p) for p in self._special.split(text)]
        return [self._normalise(text)]

    def _known(self, pieces: pa.Array) -> pa.Array:
        """The ids (in bytes) of distinct pieces, from the memo or anew; a full memo keeps those that are asked for."""
        keys, ids = self._memo
        at = np.array(pc.index_in(pieces, value_set=keys).fill_null(-1))
        new = at < 0
        if new.any():
            missing = pieces.filter(pa.array(new))
            if len(keys) + len(missing) > MEMO_PIECES:
                held = at[~new]
                keys, ids, at[~new] = keys.take(pa.array(held)), ids.take(pa.array(held)), np.arange(len(held))
            at[new] = np.arange(len(keys), len(keys) + len(missing))
            fresh = [self._encode_pieces(missing.slice(a, 1 << 16)) for a in range(0, len(missing), 1 << 16)]
            self._memo = keys, ids = pa.concat_arrays([keys, missing]), pa.concat_arrays([ids, *fresh])
        return ids.take(pa.array(at))

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of normalised texts without special tokens: each distinct piece between white space is looked up once."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        pieces = split.flatten().dictionary_encode()
        starts, data = _held(self._known(pieces.dictionary).take(pieces.indices))
        cuts = starts[split.offsets.to_numpy()].tolist()
        return [data[a:b].view(self.kind) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode_batch(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The ids of each text as an unsigned array: of 16 bits, or of 32 if the vocabulary has more than 65536 ids."""
        parts = [self._parts(t) for t in texts]
        plain = iter(self._encode_plain([p for x in parts for p in x if isinstance(p, str)]))
        ids = [[next(plain) if isinstance(p, str) else np.array([p], self.kind) for p in x] for x in parts]
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in ids]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by a space: this vocabulary's file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))

    def decimal(self, ids: np.ndarray) -> str:
        return " ".join(map(self._decimal.__getitem__, ids.tolist()))


_OPEN: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """The encoder of a file, read once by each Python worker."""
    if path not in _OPEN:
        _OPEN[path] = WordBpe(path)
    return _OPEN[path]


def grouped(batches: Iterator[pd.DataFrame], text_col: str = "text", chars: int = GROUP_CHARS) -> Iterator[pd.DataFrame]:
    """The rows of Arrow batches in slices of about `chars` characters, so that memory follows text size."""
    for batch in batches:
        start, size = 0, 0
        for i, text in enumerate(batch[text_col]):
            size += len(text)
            if size >= chars:
                yield batch.iloc[start : i + 1]
                start, size = i + 1, 0
        if start < len(batch):
            yield batch.iloc[start:]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every text; null text: no ids. Other columns are not read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path)
        for part in grouped(batches):
            yield pd.DataFrame({"doc_id": whole_ids(part.doc_id), "ids": [x.astype(np.int32) for x in bpe.encode_batch(part.text)]})

    return _texts(docs, id_col, text_col).mapInPandas(trimmed(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded text of each row's ids; null ids: empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path)
        for part in batches:
            texts = ["" if ids is None else bpe.decode(np.asarray(ids)) for ids in part.ids]
            yield pd.DataFrame({"doc_id": whole_ids(part.doc_id), "text": texts})

    return encoded.select(text_id("doc_id").alias("doc_id"), "ids").mapInPandas(trimmed(run), "doc_id long, text string")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(text_id(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Encodes each whole text and decodes its ids in the same pass, so ids never
    leave the task. Null counts as empty: no tokens, digests of empty strings.
    Repeated rows give repeated results; other columns of docs are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for part in grouped(batches):
            ids = bpe.encode_batch(part.text)
            yield pd.DataFrame({
                "doc_id": whole_ids(part.doc_id),
                "n_tokens": [len(x) for x in ids],
                "ids_sha256": [sha(bpe.decimal(x)) for x in ids],
                "decoded_sha256": [sha(bpe.decode(x)) for x in ids],
            })

    return _texts(docs, id_col, text_col).mapInPandas(trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
