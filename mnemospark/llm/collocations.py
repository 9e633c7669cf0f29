"""Phrase collocations from weighted acyclic automata.

Shards of n-grams become count transducers: minimal acyclic automata over
words whose path weights add up to an n-gram's count, built word by word from
sorted n-grams. Transducers are kept for prefix ranges (a slice of the hash of
the first word, and of the second one, so that a common first word is dealt
over several); those of a range are united, equal n-grams adding up. The parts
of a cut candidate are looked up by composing a transducer of requests with
the counts of its range.

Before n-grams are counted by their words, two passes count their hashes: one
of words and pairs, one of the longer n-grams made of frequent pairs. What is
too rare for a candidate ends there: an n-gram of the least count has only
parts of that count. The rest is remembered in Bloom filters of a bounded size:
they let too much pass where they are full or hashes collide, never too little,
and the transducers' counts are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm._common import lookup, materialise, trimmed

#: Words of a candidate at most.
LONGEST = 4
#: A shard: n-grams of about so many words are counted in memory at once.
SHARD_WORDS = 2_500_000
#: Rows are handed to Spark in slices of so many.
SLICE_ROWS = 500_000
#: A filter has about so many bits an entry, and never over 2 ** FILTER_BITS (16 MB, the bound of what is broadcast).
ENTRY_BITS, FILTER_BITS = 16, 27
#: A prefix range has about so many frequent word pairs.
RANGE_PAIRS = 4000
#: The second word's hash is cut into 2 ** SECOND_BITS slices.
SECOND_BITS = 2
#: Transducers of a range are united as soon as so many wait.
WAITING = 32
#: First rows of a language are found among those of so many slices.
TOP_SLICES = 64
SEED = 42  # of Spark's own xxhash64
NO_LANG = "und"

_FOLD = bytearray(range(256))
_FOLD[65:91] = range(97, 123)
_FOLD[9] = 32
for _b in b".,;:!?\x0a\x0b\x0c\x0d":
    _FOLD[_b] = 10
_FOLD = bytes(_FOLD)
_BREAK, _EMPTY = b"\n", b""


def tokens(text: str) -> list[bytes]:
    """Words, lower-cased in A-Z, with b"\\n" between pieces; empty ones are to be skipped."""
    return text.encode().translate(_FOLD).replace(b"\n", b" \n ").split(b" ")


class Transducer:
    """A minimal acyclic automaton from word sequences to whole numbers (the sum along the path).

    State 0 is the root; `own` is what a sequence that ends in a state adds
    (-1: none ends there), arcs lie between `first[s]` and `first[s + 1]` in
    the order of their words.
    """

    def __init__(self, words: list[bytes], first, label, target, weight, own):
        self.words, self.first, self.label, self.target, self.weight, self.own = words, first, label, target, weight, own

    @classmethod
    def build(cls, entries: Iterable[tuple[tuple[bytes, ...], int]]) -> Transducer:
        """From sorted (sequence, number) pairs of distinct, non-empty sequences."""
        names: dict[bytes, int] = {}
        known: dict[tuple, int] = {}
        states: list[tuple] = [()]  # (own, arcs) of each; the root's come last

        def freeze(own: int, arcs: list[tuple[int, int, int]]) -> tuple[int, int]:
            """The least weight below, and the state that is left when it has moved up the arc."""
            least = min([w for _, w, _ in arcs] + [own] * (own >= 0))
            key = (own - least if own >= 0 else -1, tuple((x, w - least, t) for x, w, t in arcs))
            at = known.get(key)
            if at is None:
                at = known[key] = len(states)
                states.append(key)
            return least, at

        path: list[list] = [[-1, []]]
        last: tuple[bytes, ...] = ()

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                own, arcs = path.pop()
                weight, at = freeze(own, arcs)
                path[-1][1].append((names.setdefault(last[len(path) - 1], len(names)), weight, at))

        for sequence, number in entries:
            common = 0
            for x, y in zip(sequence, last, strict=False):
                if x != y:
                    break
                common += 1
            close(common)
            last = sequence
            path += [[-1, []] for _ in range(len(sequence) - common)]
            path[-1][0] = number
        close(0)
        states[0] = (-1, tuple(path[0][1]))
        first = np.cumsum([0, *(len(a) for _, a in states)]).astype("<i4")
        label, weight, target = (np.array([arc[k] for _, a in states for arc in a], kind) for k, kind in ((0, "<i4"), (1, "<i8"), (2, "<i4")))
        return cls(list(names), first, label, target, weight, np.array([o for o, _ in states], "<i8"))

    @classmethod
    def of_rows(cls, names: list[bytes], rows: np.ndarray, n: np.ndarray) -> Transducer:
        """From sorted rows of word numbers (from 1 into names, 0 behind the end); a row's prefixes of two words or more are rows too.

        For a shard, which is united soon: only the ends are shared, as one state.
        """
        bare = np.setdiff1d(rows[:, 0], rows[rows[:, 1] == 0, 0])  # first words whose own count another range has
        rows = np.concatenate((rows, np.pad(bare[:, None], ((0, 0), (0, LONGEST - 1)))))
        n = np.concatenate((n, np.full(len(bare), -1)))
        by = np.lexsort(rows.T[::-1])
        rows, n = rows[by], n[by]
        depth = (rows > 0).sum(axis=1)
        used, label = np.unique(rows[np.arange(len(rows)), depth - 1], return_inverse=True)
        at, parent = np.arange(len(rows)), np.full(len(rows), -1)
        for d in range(2, LONGEST + 1):
            before = np.maximum.accumulate(np.where(depth == d - 1, at, -1))
            parent[depth == d] = before[depth == d]
        inner = np.bincount(parent[parent >= 0], minlength=len(rows)) > 0
        state = np.where(inner, np.cumsum(inner), inner.sum() + 1)  # 0 is the root, the last one the end
        least = np.where(n < 0, np.iinfo(np.int64).max, n)
        for d in range(LONGEST, 1, -1):
            np.minimum.at(least, parent[depth == d], least[depth == d])
        own = np.full(inner.sum() + 2, -1, np.int64)
        own[state[inner]], own[-1] = np.where(n < 0, -1, n - least)[inner], 0
        source = np.where(parent >= 0, state[parent], 0)
        weight = least - np.where(parent >= 0, least[parent], 0)
        order = np.argsort(source, kind="stable")
        first = np.searchsorted(source[order], np.arange(len(own) + 1))
        return cls([names[k - 1] for k in used.tolist()], first.astype("<i4"), label[order].astype("<i4"), state[order].astype("<i4"), weight[order].astype("<i8"), own.astype("<i8"))

    def to_bytes(self) -> bytes:
        parts = [self.first, self.label, self.target, self.weight, self.own]
        return np.array([len(self.own), len(self.label)], "<i8").tobytes() + b"".join(p.tobytes() for p in parts) + b" ".join(self.words)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Transducer:
        states, arcs = np.frombuffer(raw, "<i8", 2).tolist()
        at, parts = 16, []
        for kind, n in (("<i4", states + 1), ("<i4", arcs), ("<i4", arcs), ("<i8", arcs), ("<i8", states)):
            parts.append(np.frombuffer(raw, kind, n, at))
            at += parts[-1].nbytes
        return cls(raw[at:].split(b" ") if arcs else [], *parts)

    def _plain(self) -> tuple[list, list[list[tuple[bytes, int, int]]]]:
        """own, and each state's arcs as (word, weight, target)."""
        arcs = list(zip(map(self.words.__getitem__, self.label.tolist()), self.weight.tolist(), self.target.tolist(), strict=True))
        first = self.first.tolist()
        return self.own.tolist(), [arcs[a:b] for a, b in zip(first, first[1:], strict=False)]

    def items(self) -> Iterator[tuple[tuple[bytes, ...], int]]:
        """(sequence, number), sorted."""
        own, arcs = self._plain()
        waiting: list[tuple[int, tuple[bytes, ...], int]] = [(0, (), 0)]
        while waiting:
            at, sequence, sum_ = waiting.pop()
            if own[at] >= 0:
                yield sequence, sum_ + own[at]
            waiting.extend((t, (*sequence, x), sum_ + w) for x, w, t in reversed(arcs[at]))

    def compose(self, other: Transducer) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
        """(sequence, number here, number there) of the sequences that both have, by walking both at once."""
        own_a, arcs_a = self._plain()
        own_b, arcs_b = other._plain()
        by_word: dict[int, dict] = {}
        waiting: list[tuple] = [(0, 0, (), 0, 0)]
        while waiting:
            a, b, sequence, x, y = waiting.pop()
            if own_a[a] >= 0 and own_b[b] >= 0:
                yield sequence, x + own_a[a], y + own_b[b]
            if arcs_a[a] and arcs_b[b]:
                if b not in by_word:
                    by_word[b] = {word: (w, t) for word, w, t in arcs_b[b]}
                there = by_word[b]
                waiting.extend((t, there[word][1], (*sequence, word), x + w, y + there[word][0]) for word, w, t in arcs_a[a] if word in there)


def unite(parts: list[Transducer]) -> Transducer:
    """One transducer; numbers of a sequence that several have add up."""
    total: dict[tuple[bytes, ...], int] = {}
    for part in parts:
        for sequence, n in part.items():
            total[sequence] = total.get(sequence, 0) + n
    return Transducer.build(sorted(total.items()))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, SEED)


def _salt(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 7)


def _longer(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes of n-grams one word longer than those of g, which begin at the same places; h: hashes of words."""
    return _mix(g[:-1] * np.uint64(3)) + h[len(h) - len(g) + 1 :]


def _gram_hashes(h: np.ndarray, has_pair: Filter) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, which are of words without an end and of frequent pairs only) of the pairs, threes and fours that begin at each place."""
    g = _longer(h, h)
    ok = (h[:-1] != _END) & (h[1:] != _END)
    ok[ok] = has_pair.has(g[ok])
    out, pair = [(g, ok)], ok
    for k in (1, 2):
        g, ok = _longer(g, h), ok[:-1] & pair[k:]
        out.append((g, ok))
    return out


class Filter:
    """A Bloom filter of 64-bit hashes with two places each."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def size(entries: int) -> int:
        return 1 << min(FILTER_BITS, max(10, (ENTRY_BITS * entries).bit_length()))

    @classmethod
    def of(cls, hashes: DataFrame, entries: int) -> Filter:
        """Of the long column `hash`; 2 ** (FILTER_BITS - 6) words at most reach the driver."""
        size = cls.size(entries)
        places = hashes.select(F.explode(F.array(F.col("hash").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(size - 1)))).alias("p"))
        words = places.groupBy(F.shiftrightunsigned("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("v")).toPandas()
        bits = np.zeros(size >> 6, np.int64)
        bits[words.w.to_numpy(np.int64)] = words.v.to_numpy(np.int64)
        return cls(bits.view(np.uint64))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        size, out = np.uint64(len(self.bits) * 64 - 1), np.ones(len(hashes), bool)
        for place in (hashes & size, (hashes >> np.uint64(32)) & size):
            out &= (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return out


#: Codes of what is no word: a piece's end, and nothing between two blanks. Hashes of words are odd.
_END, _SKIP = 0, 2
_NONE = np.zeros(LONGEST, np.uint64)  # ends, so that no array is shorter than the longest n-gram


class _Index(dict):
    """Words numbered as they come; `new` are those without a code yet."""

    def __init__(self):
        super().__init__({_BREAK: 0, _EMPTY: 1})
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class _Coder:
    """Texts of one language as arrays of word hashes; words that the filter hasn't become ends."""

    def __init__(self, lang: str, words: Filter | None):
        self.salt, self.filter, self.index = np.uint64(_salt(lang)), words, _Index()
        self.codes = np.array([_END, _SKIP], np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        found = tokens(text)
        at = np.fromiter(map(self.index.__getitem__, found), np.int64, len(found))
        if self.index.new:
            known = len(self.index) - len(self.index.new)
            if len(self.index) > len(self.codes):
                self.codes = np.resize(self.codes, 2 * len(self.index))
            self.codes[known : len(self.index)] = self.code(self.index.new)
            self.index.new = []
        codes = self.codes[at]
        return codes[codes != _SKIP]

    def code(self, new: list[bytes]) -> np.ndarray:
        h = _mix(np.array([_hash(w) for w in new], np.uint64) + self.salt) | np.uint64(1)
        return h if self.filter is None else np.where(self.filter.has(h), h, np.uint64(_END))


def _shards(batches: Iterator[pd.DataFrame], coder: Callable[[str], Callable], words: int) -> Iterator[dict[str, tuple]]:
    """lang -> (its coder, its codes with an end after each text), whenever about `words` words have come."""
    coders: dict[str, Callable] = {}
    held: dict[str, list] = {}
    size, end = 0, np.zeros(1, np.uint64)
    for batch in batches:
        for lang, text in zip(batch.lang, batch.text, strict=True):
            if lang not in coders:
                coders[lang], held[lang] = coder(lang), []
            codes = coders[lang](text)
            held[lang] += [codes, end]
            size += len(codes)
            if size >= words:
                yield {x: (coders[x], np.concatenate(c)) for x, c in held.items()}
                coders, held, size = {}, {}, 0
    if held:
        yield {x: (coders[x], np.concatenate(c)) for x, c in held.items()}


def _counted(lang: str | None, size: int, hashes: np.ndarray) -> Iterator[pd.DataFrame]:
    h, n = np.unique(hashes, return_counts=True)
    for k in range(0, len(h), SLICE_ROWS):
        yield pd.DataFrame({"lang": lang, "size": size, "hash": h[k : k + SLICE_ROWS].view(np.int64), "n": n[k : k + SLICE_ROWS]}).astype({"lang": object, "size": np.int32})


def _count_short(shard_words: int):
    """Words by language and pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard in _shards(batches, lambda lang: _Coder(lang, None), shard_words):
            for lang, (_, codes) in shard.items():
                yield from _counted(lang, 1, codes[codes != _END])
                yield from _counted(None, 2, _longer(codes, codes)[(codes[:-1] != _END) & (codes[1:] != _END)])

    return run


def _count_long(words, pairs, shard_words: int):
    """Threes and fours of frequent pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard in _shards(batches, lambda lang: _Coder(lang, words.value), shard_words):
            for _, codes in shard.values():
                for size, (g, ok) in enumerate(_gram_hashes(np.r_[codes, _NONE], pairs.value)[1:], 3):
                    yield from _counted(None, size, g[ok])

    return run


class _Numbers(_Coder):
    """Texts as numbers of words (from 3, in the order they come); rare words are ends."""

    def __init__(self, lang: str, words: Filter):
        super().__init__(lang, words)
        self.words: list[bytes] = []
        self.hashes: list[int] = []

    def code(self, new: list[bytes]) -> np.ndarray:
        h = super().code(new)
        at = np.flatnonzero(h != _END)
        out = np.full(len(new), _END, np.uint64)
        out[at] = np.arange(len(at), dtype=np.uint64) + np.uint64(len(self.words) + 3)
        self.words += [new[k] for k in at]
        self.hashes += h[at].tolist()
        return out


def cell_of(words: list[bytes], first_bits: int) -> int:
    """The prefix range of a sequence."""
    first = _hash(words[0]) >> (64 - first_bits) if first_bits else 0
    return (first << SECOND_BITS) + (_hash(words[1]) >> (64 - SECOND_BITS) if len(words) > 1 else 0)


def _build(words, pairs, longer, first_bits: int, shard_words: int):
    def transducers(coder: _Numbers, codes: np.ndarray) -> Iterator[tuple[int, bytes]]:
        order = sorted(range(len(coder.words)), key=coder.words.__getitem__)
        names = [coder.words[k] for k in order]
        rank = np.zeros(len(order) + 3, np.int64)
        rank[np.array(order, np.int64) + 3] = np.arange(1, len(order) + 1)
        ids = rank[codes.astype(np.int64)]  # 0: an end; else from 1 in the order of the words
        h = np.zeros(len(order) + 1, np.uint64)
        h[1:] = np.array(coder.hashes, np.uint64)[order]
        (_, ok), *rest = _gram_hashes(h[ids], pairs.value)
        for g, long in rest:
            long[long] = longer.value.has(g[long])
        rest[1][1][:] &= rest[0][1][:-1]  # an n-gram stands with its prefixes only
        one, n_one = np.unique(ids[ids > 0], return_counts=True)
        two, back, n_two = np.unique((ids[:-1] << 32 | ids[1:])[ok], return_inverse=True, return_counts=True)
        number = np.zeros(len(ids) - 1, np.int64)
        number[ok] = back
        three, n_three = np.unique((number[:-1] << 32 | ids[2:])[rest[0][1]], return_counts=True)
        four, n_four = np.unique((number[:-2] << 32 | number[2:])[rest[1][1]], return_counts=True)
        low = (1 << 32) - 1
        rows = np.zeros((len(one) + len(two) + len(three) + len(four), LONGEST), np.int64)
        a, b, c = np.cumsum([len(one), len(two), len(three)])
        rows[:a, 0] = one
        for at, pair in ((slice(a, b), two), (slice(b, c), two[three >> 32]), (slice(c, None), two[four >> 32])):
            rows[at, 0], rows[at, 1] = pair >> 32, pair & low
        rows[b:c, 2] = three & low
        rows[c:, 2], rows[c:, 3] = two[four & low] >> 32, two[four & low] & low
        n = np.concatenate((n_one, n_two, n_three, n_four))
        place = np.zeros(len(names) + 1, np.uint64)
        place[1:] = [_hash(w) for w in names]
        first = place[rows[:, 0]] >> np.uint64(64 - first_bits) if first_bits else np.zeros(len(rows), np.uint64)
        cells = (first << np.uint64(SECOND_BITS)) + np.where(rows[:, 1] > 0, place[rows[:, 1]] >> np.uint64(64 - SECOND_BITS), np.uint64(0))
        by = np.lexsort((*rows.T[::-1], cells))
        rows, n, cells = rows[by], n[by], cells[by]
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(cells)], strict=True):
            yield int(cells[s]), Transducer.of_rows(names, rows[s:e], n[s:e]).to_bytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard in _shards(batches, lambda lang: _Numbers(lang, words.value), shard_words):
            for lang, (coder, codes) in shard.items():
                if coder.words:
                    found = list(transducers(coder, np.r_[codes, _NONE]))
                    yield pd.DataFrame({"lang": lang, "cell": [c for c, _ in found], "held": [x for _, x in found]})

    return run


def _unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (lang, cell); one united transducer for each."""
    at: tuple | None = None
    waiting: list[Transducer] = []

    def done() -> pd.DataFrame:
        whole = waiting[0] if len(waiting) == 1 else unite(waiting)
        return pd.DataFrame({"lang": [at[0]], "cell": [at[1]], "held": [whole.to_bytes()]})

    for batch in batches:
        for lang, cell, held in zip(batch.lang, batch.cell, batch.held, strict=True):
            if (lang, cell) != at:
                if at is not None:
                    yield done()
                at, waiting = (lang, cell), []
            waiting.append(Transducer.from_bytes(held))
            if len(waiting) >= WAITING:
                waiting = [unite(waiting)]
    if at is not None:
        yield done()


def _candidates(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, held in zip(batch.lang, batch.held, strict=True):
                rows = [(b" ".join(x).decode(), n) for x, n in Transducer.from_bytes(held).items() if n >= least and len(x) > 1]
                yield pd.DataFrame(rows, columns=["phrase", "a"]).assign(lang=lang)[["lang", "phrase", "a"]]

    return run


def _look_up(key: tuple, counts: pd.DataFrame, requests: pd.DataFrame) -> pd.DataFrame:
    """The counts of the requested sequences of one prefix range."""
    rows: list[tuple] = []
    if len(counts) and len(requests):
        asked = sorted((tuple(p.encode().split(b" ")), int(n)) for p, n in zip(requests.part, requests.asks, strict=True))
        rows = [(b" ".join(x).decode(), n, f) for x, n, f in Transducer.build(asked).compose(Transducer.from_bytes(counts.held[0]))]
    return pd.DataFrame(rows, columns=["part", "asks", "f"]).assign(lang=key[0])[["lang", "part", "asks", "f"]]


def phrase_counts(docs: DataFrame, least: int, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, int]:
    """(lang, cell, held): the count transducers, stored; (lang, n): all words; the bits of a first word in `cell`.

    They have every word and phrase of two to four words with `least`
    occurrences, and some rarer ones.
    """
    spark = docs.sparkSession
    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema, cast = "lang string, size int, hash long, n long", spark.sparkContext.broadcast
    frequent = F.col("n") >= least
    short = read.mapInPandas(trimmed(_count_short(shard_words)), schema).groupBy("lang", "size", "hash").agg(F.sum("n").alias("n"))
    short = materialise(short.where((F.col("size") == 1) | frequent), "short-grams")
    kept = {size: short.where((F.col("size") == size) & frequent) for size in (1, 2)}
    n_pairs = kept[2].count()
    has_word, has_pair = cast(Filter.of(kept[1], kept[1].count())), cast(Filter.of(kept[2], n_pairs))
    long = read.mapInPandas(trimmed(_count_long(has_word, has_pair, shard_words)), schema).groupBy("size", "hash").agg(F.sum("n").alias("n"))
    long = materialise(long.where(frequent), "long-grams")
    has_long = cast(Filter.of(long, long.count()))
    first_bits = min(24, max(0, (n_pairs // RANGE_PAIRS).bit_length()))
    shards = read.mapInPandas(trimmed(_build(has_word, has_pair, has_long, first_bits, shard_words)), "lang string, cell long, held binary")
    united = shards.repartition("lang", "cell").sortWithinPartitions("lang", "cell").mapInPandas(trimmed(_unite), "lang string, cell long, held binary")
    return materialise(united, "count-transducers"), short.where("size = 1").groupBy("lang").agg(F.sum("n").alias("n")), first_bits


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, contained: int = 80, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of two to four words.

    A phrase has at least `least` occurrences (a); l and r are those of the
    parts of its lowest-scoring cut, score floor(2000000 * a / (l + r)). Phrases
    within a longer one that has `contained` percent of their occurrences or
    more are dropped. Null text counts as empty, null lang as `und`; repeated
    rows count each; an empty table gives no rows. Other columns of docs are
    not read.
    """
    counts, totals, first_bits = phrase_counts(docs, least, shard_words)
    found = materialise(counts.select("lang", "held").mapInPandas(trimmed(_candidates(least)), "lang string, phrase string, a long"), "candidates")
    words, size = F.split("phrase", " ", -1), F.size(F.split("phrase", " ", -1))
    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice(words, F.col("k") + 1, size - F.col("k")), " ").alias("tail"))
    cut = materialise(cut, "cuts")
    asked = cut.select("lang", F.explode(F.array("head", "tail")).alias("part")).groupBy("lang", "part").agg(F.count("*").alias("asks"))
    part = F.split("part", " ", -1)
    second = F.when(F.size(part) > 1, F.shiftrightunsigned(F.xxhash64(F.get(part, F.lit(1))), 64 - SECOND_BITS)).otherwise(0)
    first = F.shiftrightunsigned(F.xxhash64(F.get(part, F.lit(0))), 64 - first_bits) if first_bits else F.lit(0)
    asked = asked.withColumn("cell", (F.lit(1 << SECOND_BITS) * first + second).cast("long"))
    parts = counts.groupBy("lang", "cell").cogroup(asked.groupBy("lang", "cell")).applyInPandas(_look_up, "lang string, part string, asks long, f long")
    parts = materialise(parts, "part-counts")
    sides = [parts.select("lang", F.col("part").alias(side), "asks", F.col("f").alias(name)) for side, name in (("head", "l"), ("tail", "r"))]
    left = lookup(cut, sides[0], ["lang", "head"], "asks", ["phrase"]).drop("asks")
    both = lookup(left, sides[1], ["lang", "tail"], "asks", ["phrase"]).drop("asks")
    score = F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * F.col("a").cast("decimal(19,0)"), (F.col("l") + F.col("r")).cast("decimal(19,0)"))
    scored = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    longer = found.withColumn("words", words).where(F.size("words") > 2).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * contained))
    flat = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = flat.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SLICES))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
