"""Repeated passages by sparse suffix arrays.

Texts are sequences of words (split at white space). Of all suffixes only
those at minimiser positions stay: a position is retained if the hash of the
GRAM words that begin there is the least in some run of WINDOW positions. A
passage of LEAST = GRAM + WINDOW - 1 words is one such run, so it belongs to
exactly one retained suffix, at the same place in every text that has it.

1. Retained suffixes are sorted by the hash of their first GRAM words and
   compared with their neighbours; those unlike both of them end here.
2. The others are sorted by content: by their first GRAM words as text, then
   by document. Each is compared word by word with the first suffixes (of the
   earliest documents) in its run of equal ones, and the match is extended to the left and
   to the right as far as the suffix's passages reach.
3. Passages that these do not share may still be shared by
   others of the run: they are sorted by a 128-bit digest of their words and
   compared with the first of their equals.

Every sort is cut into ranges, also within a run of equal suffixes, so a
passage that very many documents share is spread over many tasks; what lies at
the ranges' edges (a few rows a task) is matched up in the third step. Nothing
is capped. The occurrence in the document with the smallest id stays; all
others are reported, or cut out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm._common import lookup, materialise, trimmed

GRAM, WINDOW = 26, 25
LEAST = GRAM + WINDOW - 1
GROUP_CHARS = 1 << 20
#: Rows that a task hands on at once: each holds some sixty words.
OUT_ROWS = 4096
MEMO_WORDS = 200_000
#: Suffixes of a run that the others are compared with; more of them leave fewer passages open.
LEADERS = 8
_WORD = re.compile(r"\S+")
_BASE = 0x9E3779B97F4A7C15


class WordHashes:
    """The 64-bit hashes of words, with a bounded memo."""

    def __init__(self):
        self._memo: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        memo = self._memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def rolling(words: np.ndarray, length: int, base: int = _BASE) -> np.ndarray:
    """The hash of every run of `length` words: a polynomial modulo 2**64, by prefix sums, then mixed."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    inverse = pow(base, -1, 1 << 64)
    one = np.ones(1, np.uint64)
    up, down = (np.cumprod(np.concatenate((one, np.full(n, b, np.uint64)))) for b in (base, inverse))
    sums = np.concatenate((one - one, np.cumsum(words * down[:n])))
    h = (sums[length:] - sums[: n - length + 1]) * up[: n - length + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def minimisers(grams: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions whose gram hash is the least (the leftmost of equals) of some run of `window`; the first such run, and how many.

    Runs with one minimiser follow one another, so every run belongs to one position.
    """
    if len(grams) < window:
        return (np.zeros(0, np.int64),) * 3
    out = []
    for a in range(0, len(grams) - window + 1, 1 << 16):
        runs = np.lib.stride_tricks.sliding_window_view(grams[a : a + (1 << 16) + window - 1], window)
        out.append(a + np.arange(len(runs)) + runs.argmin(axis=1))
    return np.unique(np.concatenate(out), return_index=True, return_counts=True)


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        start = held = 0
        for i, text in enumerate(batch["text"]):
            held += len(text)
            if held >= GROUP_CHARS:
                yield batch.iloc[start : i + 1]
                start, held = i + 1, 0
        if start < len(batch):
            yield batch.iloc[start:]


def _key(text: Column) -> Column:
    """128 bits of the text's SHA-256: equal texts are worked on once, unlike ones never share a key."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def _texts(docs: DataFrame) -> DataFrame:
    """no_id, id (0 where there is none), text and doc: the key of the text."""
    doc_id = docs["doc_id"].cast("long")
    return docs.select(doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.coalesce(docs["text"], F.lit("")).alias("text"), _key(docs["text"]).alias("doc"))


def retained(docs: DataFrame) -> DataFrame:
    """suffix (hash of its first GRAM words) and doc of every retained suffix; a stored table.

    Of equal suffixes in one text the first is kept. Each row of docs with
    LEAST words or more adds a head: suffix null, its no_id and id, its count
    of words, and the characters begin, end of its words.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for part in _groups(batches):
            suffix, head = [], []
            for i, text in enumerate(part.text):
                words = text.split()
                grams = rolling(hashes(words), GRAM)
                suffix.append(np.unique(grams[minimisers(grams)[0]]).view(np.int64))
                if len(words) >= LEAST:
                    head.append((i, len(words), len(text) - len(text.lstrip()), len(text.rstrip())))
            doc = part.doc.to_numpy()
            rows = np.repeat(doc, [len(x) for x in suffix])
            yield pd.DataFrame({"suffix": pd.array(np.concatenate(suffix), "Int64"), "doc": rows, "no_id": False, "id": 0, "n_words": 0, "begin": 0, "end": 0})
            if head:
                at, n, begin, end = (np.array(x) for x in zip(*head, strict=True))
                yield pd.DataFrame({"suffix": pd.array([None], "Int64").repeat(len(at)), "doc": doc[at], "no_id": part.no_id.to_numpy()[at], "id": part.id.to_numpy()[at], "n_words": n, "begin": begin, "end": end})

    return materialise(_texts(docs).mapInPandas(trimmed(run), "suffix long, doc binary, no_id boolean, id long, n_words int, begin int, end int"), "suffixes")


def repeated(suffixes: DataFrame) -> DataFrame:
    """The rows (suffix, doc) whose suffix another text has as well; a text's copies may give a row several times.

    Sorted over the cluster by suffix and doc; each is compared with the ones
    before and after it. The first and last suffix of a range are passed on
    unless they have an equal beside them, and are looked up among the (few)
    edges of the other ranges.
    """
    from pyspark import TaskContext

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, names = TaskContext.get().partitionId(), ["suffix", "doc", "paired", "task"]
        held: pd.DataFrame | None = None  # the last row so far, not yet compared with the one after it
        first = True
        for batch in batches:
            frame = batch.assign(paired=False, task=task)
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            s, d, paired = frame["suffix"].to_numpy(), frame["doc"].to_numpy(), frame["paired"].to_numpy(bool).copy()
            same = (s[1:] == s[:-1]) & (d[1:] != d[:-1])
            paired[1:] |= same
            paired[:-1] |= same
            frame["paired"] = paired
            keep = paired.copy()
            keep[0] |= first
            first = first and len(frame) == 1
            held = frame[-1:]
            yield frame.loc[keep, names][: -1 if keep[-1] else None]
        if held is not None:
            yield held[names]

    ordered = suffixes.repartitionByRange("suffix", "doc").sortWithinPartitions("suffix", "doc")
    found = materialise(ordered.mapInPandas(trimmed(compare), "suffix long, doc binary, paired boolean, task int"), "neighbours")
    lone = found.where("NOT paired").select("suffix").distinct()  # two a range at most
    across = found.join(lone, "suffix", "left_semi").groupBy("suffix").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least <> most").select("suffix")
    matched = found.where("NOT paired").join(across, "suffix", "left_semi")
    return found.where("paired").unionByName(matched).select("suffix", "doc")


_CONTEXT = "gram string, left string, right string, no_id boolean, id long, doc binary, low int, high int, places array<int>, begins array<int>, gaps binary"


def contexts(docs: DataFrame, anchors: DataFrame, firsts: DataFrame) -> DataFrame:
    """The anchored suffixes with the words that their passages reach: gram, left, right (joined by spaces), and where.

    low .. high: how far before the suffix its passages begin. places and
    begins: the words and characters where a text has this very context; gaps:
    the white space after each word, where it isn't one character throughout.
    Of rows with equal texts only the first (firsts: doc, first) is read.
    """
    grouped = anchors.groupBy("doc").agg(F.collect_set("suffix").alias("suffixes")).join(firsts.select("doc", "first"), "doc")  # as long as a document's text at most

    def of(text: str, wanted: np.ndarray, hashes: WordHashes) -> Iterator[tuple]:
        words = text.split()
        grams = rolling(hashes(words), GRAM)
        at, first, count = minimisers(grams)
        here = np.isin(grams[at], wanted)
        bounds = np.array([m.span() for m in _WORD.finditer(text)], np.int32)
        if len(bounds) != len(words):  # separators on which the two kinds of white space differ
            bounds = _spans(text)
        gaps = bounds[1:, 0] - bounds[:-1, 1]
        odd = np.concatenate(([0], np.cumsum(gaps != 1)))
        held: dict[tuple, tuple[list[int], list[int]]] = {}
        for p, a, n in zip(at[here].tolist(), first[here].tolist(), count[here].tolist(), strict=True):
            end = a + n - 1 + LEAST
            space = gaps[a : end - 1].tobytes() if odd[end - 1] > odd[a] else None
            key = (" ".join(words[p : p + GRAM]), " ".join(words[a:p]), " ".join(words[p + GRAM : end]), p - a - n + 1, p - a, space)
            places, begins = held.setdefault(key, ([], []))
            places.append(p)
            begins.append(int(bounds[a, 0]))
            if len(held) >= OUT_ROWS:  # a very long text
                yield from ((*k, *x) for k, x in held.items())
                held = {}
        yield from ((*k, *x) for k, x in held.items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, out = WordHashes(), []
        names = [f.split(" ")[0] for f in _CONTEXT.split(", ")]
        for batch in batches:
            for no_id, i, doc, text, suffixes in zip(batch.no_id, batch.id, batch.doc, batch.text, batch.suffixes, strict=True):
                for gram, left, right, low, high, space, places, begins in of(text, np.asarray(suffixes, np.int64).view(np.uint64), hashes):
                    out.append((gram, left, right, no_id, i, doc, low, high, places, begins, space))
                    if len(out) >= OUT_ROWS:
                        yield pd.DataFrame(out, columns=names)
                        out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    texts = _texts(docs).alias("t")
    joined = texts.join(grouped.alias("g"), (F.col("t.doc") == F.col("g.doc")) & (F.col("t.id") == F.col("g.first.id")) & (F.col("t.no_id") == F.col("g.first.no_id")))
    return joined.select("t.no_id", "t.id", "t.doc", "text", "suffixes").mapInPandas(trimmed(run), _CONTEXT)


def _spans(text: str) -> np.ndarray:
    out, at = [], 0
    for w in text.split():
        at = text.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return np.array(out, np.int32).reshape(-1, 2)


def common(a: list[str], b: list[str]) -> int:
    """How many words a and b begin with in common."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


_MATCH = "passage binary, no_id boolean, id long, doc binary, start int, n_words int, begin int, end int, first_no_id boolean, first_id long"


class _Suffix:
    """One row of contexts()."""

    def __init__(self, gram, left, right, no_id, i, doc, low, high, places, begins, gaps):
        self.gram, self.no_id, self.id, self.doc, self.low, self.high, self.places, self.begins = gram, no_id, i, doc, low, high, places, begins
        self.text = left, right
        self.left = left.split(" ")[::-1] if left else []
        self.right = right.split(" ") if right else []
        self._gaps = gaps

    def rows(self, low: int, high: int, passage: bytes | None, first: _Suffix | None) -> Iterator[tuple]:
        """A row for each place: the words from `high` before the suffix to the end of the passage that begins `low` before it."""
        words = [*self.left[::-1], *self.gram.split(" "), *self.right]
        sizes = np.array([len(w) for w in words])
        gaps = np.ones(len(words) - 1, np.int64) if self._gaps is None else np.frombuffer(self._gaps, np.int32)
        begin = np.concatenate(([0], np.cumsum(sizes[:-1] + gaps)))
        a, b = self.high - high, self.high - low + LEAST - 1
        x, y = int(begin[a]), int(begin[b] + sizes[b])
        seen = (False, 0) if first is None else (first.no_id, first.id)
        for place, at in zip(self.places, self.begins, strict=True):
            yield passage, self.no_id, self.id, self.doc, place - high, high - low + LEAST, at + x, at + y, *seen

    def passages(self, offsets) -> Iterator[tuple]:
        """Each passage that begins `o` words before the suffix, by the digest of its words."""
        words = [*self.left[::-1], *self.gram.split(" "), *self.right]
        for o in offsets:
            a = self.high - o
            yield from self.rows(o, o, xxhash.xxh3_128_digest(" ".join(words[a : a + LEAST])), None)


def extend(sorted_contexts: DataFrame) -> DataFrame:
    """Compare each suffix with the leaders of its run and extend: matches (passage null), and the passages still open.

    Leaders are the run's first document and the next LEADERS - 1 that had a
    passage of their own; those passages are out when they become leaders, so
    whatever matches a leader has a document before it, and every passage
    that no leader has is open in all documents that have it.

    The first of a range's first run and of its last one may not be the
    run's first document: their passages stay open as well.
    """
    names = [f.split(" ")[0] for f in _MATCH.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first: _Suffix | None = None
        leaders: list[_Suffix] = []  # of the run at hand: the first, and the next ones that were not fully matched
        opened = False  # the passages of `first` are out
        out: list[tuple] = []
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                s = _Suffix(*row)
                if first is None or s.gram != first.gram:
                    opened, first, leaders = first is None, s, [s]
                    if opened:
                        out += s.passages(range(s.low, s.high + 1))
                    continue
                left = range(s.low, s.high + 1)  # how far before the suffix the passages begin that are still unmatched
                for f in leaders:
                    if s.text == f.text:
                        low, high = s.low, s.high
                    else:
                        high = min(s.high, common(s.left, f.left))
                        low = max(s.low, LEAST - GRAM - common(s.right, f.right))
                    matched = [o for o in left if low <= o <= high]
                    if matched and s.doc != f.doc:
                        out += s.rows(low, high, None, f)
                    if matched:
                        left = [o for o in left if not low <= o <= high]
                    if not left:
                        break
                if left:
                    out += s.passages(left)
                    if len(leaders) < LEADERS:
                        leaders.append(s)
                if len(out) >= OUT_ROWS:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if first is not None and not opened:
            out += first.passages(range(first.low, first.high + 1))
        if out:
            yield pd.DataFrame(out, columns=names)

    return sorted_contexts.mapInPandas(trimmed(run), _MATCH)


def later(passages: DataFrame) -> DataFrame:
    """The open passages that a document before has: rows of _MATCH with the first document of their equals.

    Sorted by passage, then document; each is compared with the first of its
    run. A range's first run may begin in an earlier range: those of its rows
    that have no other document before them there are looked up among the
    firsts of the other ranges' last runs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # the first row of the run at hand
        opening: bytes | None = None  # the passage of the range's first run
        for batch in batches:
            frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
            p, doc = frame["passage"].to_numpy(), frame["doc"].to_numpy()
            new = np.ones(len(p), bool)
            new[1:] = p[1:] != p[:-1]
            head = np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
            opening = p[0] if opening is None else opening
            again = doc != doc[head]
            edge = ~again & (p == opening)
            edge[0] &= held is None
            held = frame.iloc[[head[-1]]]
            firsts = frame.iloc[head]
            frame = frame.assign(first_no_id=firsts["no_id"].to_numpy(), first_id=firsts["id"].to_numpy(), edge=edge)
            yield frame[again | edge]
        if held is not None and held["passage"].iloc[0] != opening:
            yield held.assign(edge=True)

    order = ["passage", "no_id", "id", "doc", "start"]
    ranges = passages.repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialise(ranges.mapInPandas(trimmed(run), _MATCH + ", edge boolean"), "passages")
    edges = found.where("edge").drop("edge", "first_no_id", "first_id")
    firsts = edges.groupBy("passage").agg(F.min(F.struct("no_id", "id", "doc")).alias("f"))
    across = edges.join(firsts, "passage").where(F.col("f.doc") != F.col("doc"))
    matched = across.withColumns({"first_no_id": F.col("f.no_id"), "first_id": F.col("f.id")}).drop("f")
    return found.where("NOT edge").drop("edge").unionByName(matched)


_SPANS = "no_id boolean, id long, doc binary, start_word int, n_words int, begin int, end int, first_doc_ids array<long>, windows int"


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Matches of one text that overlap or touch become one span; windows counts its passages of LEAST words."""
    for batch in batches:
        out = []
        for doc, no_id, i, parts in zip(batch.doc, batch.no_id, batch.id, batch.parts, strict=True):
            spans: list[list] = []
            for p in sorted(parts, key=lambda p: p["start"]):
                a, b = p["start"], p["start"] + p["n_words"]
                if spans and a <= spans[-1][1]:
                    last = spans[-1]
                    last[5] += max(0, b - max(last[1], a + LEAST - 1))
                    last[1], last[3] = max(last[1], b), max(last[3], p["end"])
                else:
                    spans.append([a, b, p["begin"], p["end"], set(), b - a - LEAST + 1])
                if not p["first_no_id"]:
                    spans[-1][4].add(p["first_id"])
            out += [(no_id, i, doc, a, b - a, begin, end, sorted(ids), n) for a, b, begin, end, ids, n in spans]
        yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in _SPANS.split(", ")])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """The spans of docs that repeat what a document with a smaller id has, LEAST words or more.

    doc_id, doc (a key of the text), start_word, n_words, begin, end
    (characters) and first_doc_ids: ids of documents before it that have the
    passages. Of equal texts the one with the smallest id is compared with
    other texts; the others repeat it from end to end. Documents without an id
    come last, and then the order of a text hash decides; rows repeated as they
    are count as one document. Null, empty and shorter texts have no spans;
    passages that repeat only within one document are left alone.
    """
    table = retained(docs)
    heads = table.where("suffix IS NULL").drop("suffix")
    firsts = materialise(heads.groupBy("doc").agg(F.min(F.struct("no_id", "id")).alias("first"), F.count("*").alias("n_rows")), "firsts")
    anchors = repeated(table.where("suffix IS NOT NULL").select("suffix", "doc"))
    order = ["gram", "no_id", "id", "doc"]
    around = materialise(contexts(docs, anchors, firsts), "contexts")
    found = materialise(extend(around.repartitionByRange(*order).sortWithinPartitions(*order)), "matches")
    matches = found.where("passage IS NULL").unionByName(later(found.where("passage IS NOT NULL"))).drop("passage")
    parts = F.collect_set(F.struct("start", "n_words", "begin", "end", "first_no_id", "first_id")).alias("parts")
    spans = materialise(matches.groupBy("doc", "no_id", "id").agg(parts).mapInPandas(trimmed(_merge), _SPANS), "spans")
    # Copies: their passages occur first where those of the first of them do, or in it.
    known = spans.groupBy("doc").agg(F.flatten(F.collect_list("first_doc_ids")).alias("ids"), F.sum("windows").alias("windows"))
    again = lookup(heads, firsts.where("n_rows > 1"), ["doc"], "n_rows", ["id"]).where("first IS NOT NULL")
    copies = again.where((F.col("id") != F.col("first.id")) | (F.col("no_id") != F.col("first.no_id"))).drop("n_rows").distinct()
    copies = lookup(copies, materialise(known.join(firsts.where("n_rows > 1").select("doc", "n_rows"), "doc"), "known"), ["doc"], "n_rows", ["id"])
    none = F.array().cast("array<bigint>")
    own = F.when((F.coalesce("windows", F.lit(0)) < F.col("n_words") - LEAST + 1) & ~F.col("first.no_id"), F.array("first.id")).otherwise(none)
    ids = F.array_sort(F.array_distinct(F.concat(F.coalesce("ids", none), own)))
    whole = copies.select("no_id", "id", "doc", F.lit(0).alias("start_word"), "n_words", "begin", "end", ids.alias("first_doc_ids"))
    return spans.drop("windows").unionByName(whole).select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "doc", "start_word", "n_words", "begin", "end", "first_doc_ids")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs without repeated spans; documents of which no word is left are dropped.

    Keeps the columns; n_chars, if there, becomes the new length of texts
    that were cut. Null and empty texts stay as they are.
    """
    names = docs.columns
    spans = repeated_spans(docs).groupBy("doc", F.col("doc_id").alias("span_id")).agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("cut_spans"))
    doc_id = docs["doc_id"].cast("long")
    keyed = docs.select(F.struct(*[docs[c] for c in names]).alias("kept_row"), doc_id.alias("row_id"), _key(docs["text"]).alias("row_doc"))
    joined = keyed.join(spans, (F.col("row_doc") == F.col("doc")) & F.col("row_id").eqNullSafe(F.col("span_id")), "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans, strict=True):
            at, parts = 0, []
            for p in s:
                parts.append(t[at : p["begin"]])
                at = p["end"]
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    whole = joined.where("cut_spans IS NULL").select([F.col(f"kept_row.{c}").alias(c) for c in names])
    shorter = joined.where("cut_spans IS NOT NULL").withColumn("cut_text", cut(F.col("kept_row.text"), F.col("cut_spans")))
    shorter = shorter.where(F.col("cut_text").rlike(r"\S"))
    new = {"text": F.col("cut_text"), "n_chars": F.length("cut_text").cast("long")}
    return whole.unionByName(shorter.select([new.get(c, F.col(f"kept_row.{c}")).alias(c) for c in names]))
