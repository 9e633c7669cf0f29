"""Source divergence audit: how far the term shares of sources lie apart, exactly.

Map tasks count terms and the documents that hold them, combined before
anything is shuffled. Each language keeps the terms of enough documents and
numbers them; each group (a source of a language) becomes sorted arrays of
(term id, count), cut into parts of a bounded range of ids. The parts of two
groups are co-grouped for each unordered pair: a galloping intersection finds
the terms that both have, the others are priced against the other group's
share of an absent term, and terms that neither has are priced once for all of
them. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm._common import gapless_rank, lookup, materialise, trimmed

#: A map task hands on what it has counted when it holds so many (group, term) entries.
HELD_TERMS = 300_000
#: Rows are handed to Spark in slices of so many.
SLICE_ROWS = 50_000
#: Term ids in a part: the arrays of a group and part are no longer than this.
PART = 1 << 16
#: Shares are in parts of 10 ** 9; a share below 9.2e15 tokens a group is exact in 64 bits.
SCALE, STEP, STEPS = 10**9, 10**3, 3
#: Ids of the smaller array that are searched for in one step of the gallop.
STRIDE = 256

_SPLIT = bytes(32 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if b < 0x5B else b for b in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters and non-ASCII characters; A-Z lower-cased."""
    return text.encode().translate(_SPLIT).split()


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for (lang, source), (occurrences, docs) in held.items():
            for term, n in occurrences.items():
                rows.append((lang, source, term.decode(), n, docs[term]))
                if len(rows) >= SLICE_ROWS:
                    yield pd.DataFrame(rows, columns=_COUNTED)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=_COUNTED)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(batch.lang, batch.source, batch.text, strict=True):
            found = terms(text)
            occurrences, docs = held.setdefault((lang, source), (Counter(), Counter()))
            occurrences.update(found)
            docs.update(set(found))
        if sum(len(o) for o, _ in held.values()) > HELD_TERMS:
            yield from flush()
    yield from flush()


_COUNTED = ["lang", "source", "term", "n", "docs"]


def gallop(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """For each id of the sorted `small`, its place among the sorted `large`: steps double from where the last ones were found."""
    places, low = np.zeros(len(small), np.int64), 0
    for k in range(0, len(small), STRIDE):
        block = small[k : k + STRIDE]
        high, step = low, STRIDE
        while high < len(large) and large[high] < block[-1]:
            high, step = high + step, 2 * step
        places[k : k + STRIDE] = low + np.searchsorted(large[low : high + 1], block)
        low = int(places[min(k + STRIDE, len(small)) - 1])
    return places


def shares(counts: np.ndarray, smoothing: int, whole: int) -> np.ndarray:
    """1 + floor(SCALE * (count + smoothing) / whole), by long division so that no product passes 64 bits."""
    if whole >= (1 << 63) // STEP:
        raise OverflowError(f"{whole} tokens in a group are more than 64-bit division holds")
    rest = counts.astype(np.int64) + smoothing
    out = rest // whole
    rest = rest % whole
    for _ in range(STEPS):
        rest = rest * STEP
        out = out * STEP + rest // whole
        rest %= whole
    return out + 1


def _prices(smoothing: int):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        lang, a, b, _ = key
        some = (left if len(left) else right).iloc[0]
        none = np.zeros(0, np.int64)
        ids, counts = zip(*((side.ids[0], side.counts[0]) if len(side) else (none, none) for side in (left, right)), strict=True)
        wholes = int(some.whole_a), int(some.whole_b)
        p, q = (shares(c, smoothing, w) for c, w in zip(counts, wholes, strict=True))
        absent_p, absent_q = (int(shares(np.zeros(1, np.int64), smoothing, w)[0]) for w in wholes)
        if len(ids[0]) <= len(ids[1]):
            at = gallop(ids[0], ids[1])
            hit = np.flatnonzero(at < len(ids[1]))
            hit = hit[ids[1][at[hit]] == ids[0][hit]]
            in_a, in_b = hit, at[hit]
        else:
            at = gallop(ids[1], ids[0])
            hit = np.flatnonzero(at < len(ids[0]))
            hit = hit[ids[0][at[hit]] == ids[1][hit]]
            in_a, in_b = at[hit], hit
        only_a, only_b = np.delete(p, in_a), np.delete(q, in_b)
        value = int(np.abs(p[in_a] - q[in_b]).sum() + np.abs(only_a - absent_q).sum() + np.abs(absent_p - only_b).sum())
        return pd.DataFrame({"lang": [lang], "a": [a], "b": [b], "value": [value], "terms": [len(p) + len(q) - len(hit)]})

    return run


def _share(count: Column, whole: Column, smoothing: int) -> Column:
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + smoothing).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, F.greatest(whole, F.lit(1)).cast("decimal(20,0)"))


def divergence(docs: DataFrame, least_docs: int = 30, smoothing: int = 5, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: each other source of the language, by the summed differences
    of all kept terms' shares (0 if the language keeps none). Part `term`: the
    `top` kept terms whose share in the group passes that in the language.
    Null text, lang and source count as ''. A group without terms has pairs
    and no terms; rows repeated under one id count each; an empty table gives
    no rows. Other columns of docs are not read.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = read.mapInPandas(trimmed(_count), "lang string, source string, term string, n long, docs long")
    counts = materialise(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    vocabulary = materialise(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"), "vocabulary")
    numbered = gapless_rank(vocabulary, ["lang"], ["term"], "id")
    kept = materialise(counts.drop("docs").join(numbered, ["lang", "term"]), "kept-terms")
    of_lang = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_terms"))
    groups = read.select("lang", "source").distinct().join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").fillna(0)
    extra = F.col("v") * smoothing
    groups = materialise(groups.select("lang", "source", "v", "n_terms", (F.col("total") + extra).alias("whole"), (F.col("lang_total") + extra).alias("lang_whole")), "groups")

    placed = lookup(kept, groups, ["lang", "source"], "n_terms", ["term"])
    ahead = placed.withColumn("value", _share(F.col("n"), F.col("whole"), smoothing) - _share(F.col("lang_n"), F.col("lang_whole"), smoothing)).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = ahead.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    side = lambda name: groups.select("lang", F.col("source").alias(name), "v", F.col("whole").alias(f"whole_{name}"))
    pairs = materialise(side("a").join(side("b").drop("v"), "lang").where("a < b"), "pairs")  # rows of the result, twice
    entry = F.struct((F.col("id") % PART).cast("int").alias("id"), "n")
    arrays = kept.groupBy("lang", "source", F.floor(F.col("id") / PART).alias("cell")).agg(F.sort_array(F.collect_list(entry)).alias("held"))
    arrays = materialise(arrays.select("lang", "source", "cell", F.col("held.id").alias("ids"), F.col("held.n").alias("counts")), "term-arrays")
    both = [arrays.withColumnRenamed("source", s).join(pairs.drop("v"), ["lang", s]).select(*[F.col(c).alias(c) for c in ("lang", "a", "b", "cell", "ids", "counts", "whole_a", "whole_b")]) for s in ("a", "b")]
    by = ["lang", "a", "b", "cell"]
    priced = both[0].groupBy(*by).cogroup(both[1].groupBy(*by)).applyInPandas(_prices(smoothing), "lang string, a string, b string, value long, terms long")
    summed = priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    zero = F.lit(0).cast("long")
    apart = F.abs(_share(zero, F.col("whole_a"), smoothing) - _share(zero, F.col("whole_b"), smoothing))
    absent = (F.col("v") - F.coalesce("terms", zero)) * F.when(F.col("v") > 0, apart).otherwise(zero)
    whole = materialise(pairs.join(summed, ["lang", "a", "b"], "left").select("lang", "a", "b", (F.coalesce("value", zero) + absent).alias("value")), "pair-values")
    ways = whole.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(whole.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    ranked = ways.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return ranked.unionByName(best)
