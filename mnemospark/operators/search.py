"""Lexical search and what is recalled with it: plans, lessons, bundles, routing and gates. Queries are tables, so many are answered at once."""

from __future__ import annotations

import re
from hashlib import blake2b
from itertools import chain, count

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from mnemospark.functions.text import STOPWORDS
from mnemospark.storage import cut

# The usual constants of BM25, and the recall thresholds.
K1, B = 1.2, 0.75
AUTO_BIND, ESCALATE, WORKSPACE_BOOST, GIT_MATCH = 0.85, 0.60, 0.15, 0.95


def terms(docs: DataFrame) -> DataFrame:
    """id, term, tf of texts (id, text): lower-case runs of letters and digits that are not stopwords."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1), lambda w: ~w.isin(*STOPWORDS))
    return docs.where("text IS NOT NULL").select("id", F.explode(words).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def _codes(words: list[str], salt: int) -> np.ndarray:
    """A number of 64 bits for each word."""
    key = salt.to_bytes(8, "little")
    return np.fromiter((int.from_bytes(blake2b(w.encode(), digest_size=8, salt=key).digest(), "little", signed=True) for w in words), np.int64, len(words))


def _listed(shortest: int, salt: int):
    """Tasks of word_lists(): the words of a batch are numbered once, the first row of a batch names them."""
    import pyarrow as pa

    find, stop = re.compile("[a-z0-9]+").findall, frozenset(STOPWORDS)

    def run(batches):
        for batch in batches:
            found = [find(t) for t in batch.column("text").to_pylist()]
            coded = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
            words = coded.dictionary.to_pylist()
            good = np.array([len(w) >= shortest and w not in stop for w in words], dtype=bool)
            if not good.any():
                continue
            place = coded.indices.to_numpy()
            keep = good[place]
            doc = np.repeat(np.arange(len(found)), np.fromiter(map(len, found), np.int64, len(found)))
            key, tf = np.unique(doc[keep] * len(words) + place[keep], return_counts=True)
            doc, place = key // len(words), key % len(words)
            codes, sizes = _codes(words, salt), np.bincount(doc, minlength=len(found))
            rows = np.flatnonzero(sizes)
            ends = np.r_[0, np.cumsum(sizes[rows])].astype(np.int32)
            named = np.r_[0, np.full(len(rows), good.sum())].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(e), pa.array(v)) for e, v in ((ends, codes[place]), (ends, tf.astype(np.float64)), (named, codes[good]), (named, np.array(words, dtype=object)[good]))]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(np.bincount(doc, tf, minlength=len(found))[rows]), *lists], names=["id", "length", "codes", "tfs", "word_codes", "words"])

    return run


def word_lists(docs: DataFrame, shortest: int = 1) -> DataFrame:
    """id, length, codes, tfs: the terms() of texts (id, text) of `shortest` letters or more as numbers, a row a text. A stored table.

    Words are numbered by a hash of 64 bits; where two words have one number,
    all are numbered anew with another salt.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    docs = docs.where("text IS NOT NULL").select("id", F.lower("text").alias("text"))
    if not docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        docs = docs.groupBy("id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    schema = StructType([StructField("id", docs.schema["id"].dataType), StructField("length", DoubleType()), *[StructField(n, ArrayType(t)) for n, t in (("codes", LongType()), ("tfs", DoubleType()), ("word_codes", LongType()), ("words", StringType()))]])
    for salt in count():
        lists = cut(docs.mapInArrow(_listed(shortest, salt), schema), "words")
        named = lists.select(F.explode(F.arrays_zip("word_codes", "words")).alias("w")).groupBy("w.word_codes").agg(F.min("w.words").alias("a"), F.max("w.words").alias("b"))
        if named.where("a <> b").isEmpty():
            return lists.drop("word_codes", "words")


def asked_words(lists: DataFrame, which: str) -> DataFrame:
    """query_id, code of the lists that `which` holds for, as queries."""
    return lists.where(which).select(F.col("id").alias("query_id"), F.explode("codes").alias("code"))


#: Postings of a part at most, and parts that a table is cut into at least where it has FEWEST postings for each.
POSTINGS, SPREAD, FEWEST = 4_000_000, 16, 65536
#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20
#: How far apart two scores may be that are ties to 6 places.
TIE = 2e-6
#: Words of so large a share of a part's documents go in a matrix of so many cells at most, for so many queries at once; its error as a share of the score.
COMMON, CELLS, TOGETHER, ERROR = 0.15, 1 << 24, 64, 1e-4


class _Part:
    """The postings of a part's documents, by word and by document."""

    def __init__(self, docs: list):
        import pyarrow as pa

        self.ids = pa.concat_arrays([d.column("id") for d in docs])
        codes, tfs = (np.concatenate([d.column(c).flatten().to_numpy() for d in docs]) for c in ("codes", "weights"))
        self.sizes = np.concatenate([pc.list_value_length(d.column("codes")).to_numpy() for d in docs])
        self.value = np.concatenate([d.column("value").to_numpy() for d in docs])
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        self.doc = np.repeat(np.arange(len(self.ids)), self.sizes)[order]
        new = np.r_[True, codes[1:] != codes[:-1]][: len(codes)]
        self.first = np.flatnonzero(new)
        self.known, self.size = codes[self.first], np.diff(np.r_[self.first, len(codes)])
        of_doc = np.argsort(self.doc, kind="stable")
        self.word, self.tfs, self.tfs_of_word = (np.cumsum(new) - 1).astype(np.int32)[of_doc], tfs[order][of_doc], tfs[order]
        self.start = np.r_[0, np.cumsum(self.sizes)[:-1]].astype(np.int64)
        self.plain = self.ids.to_numpy(zero_copy_only=False)
        self.place = np.unique(self.plain, return_inverse=True)[1]

    def words(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the codes the part has, their words)."""
        at = np.minimum(np.searchsorted(self.known, codes), max(0, len(self.known) - 1))
        here = np.flatnonzero(self.known[at] == codes) if len(self.known) else np.array([], dtype=np.int64)
        return here, at[here]

    def k_least(self, docs: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents that may be among the k of the largest value; of equal values (copies) the k least ids are enough."""
        if len(docs) > k:
            may = value >= np.partition(value, -k)[-k] - TIE
            docs, value = docs[may], value[may]
        order = np.lexsort((self.place[docs], value))
        docs, value = docs[order], value[order]
        new = np.r_[True, value[1:] != value[:-1]][: len(value)]
        nth = np.arange(len(value)) - np.maximum.accumulate(np.where(new, np.arange(len(value)), 0))
        return docs[nth < k], value[nth < k]


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] of them, then those of the next."""
    return np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def _scored(docs: list, k: int, itself: bool):
    """The part and, for queries, their codes and idf, its documents that may be among the k best of each, with scores.

    Common words are a matrix product for many queries at once, in 32 bits;
    postings of the others are summed one after the other. What that leaves
    within its error of the k best is scored word after word, so copies have
    equal scores.
    """
    part = _Part(docs)
    norm, n = part.value, len(part.ids)  # norm: what is added to a document's tf
    weight = part.tfs_of_word * (K1 + 1) / (part.tfs_of_word + norm[part.doc])
    often = np.argsort(-part.size, kind="stable")[: CELLS // max(1, n)]
    often = often[part.size[often] >= COMMON * n]
    column = np.full(len(part.known), -1)
    column[often] = np.arange(len(often))
    dense, most = np.zeros((len(often), n), dtype=np.float32), np.zeros(len(often))
    first, last = part.first.tolist(), (part.first + part.size).tolist()
    for c, w in enumerate(often):
        dense[c, part.doc[first[w] : last[w]]] = weight[first[w] : last[w]]
        most[c] = weight[first[w] : last[w]].max()
    weighed = np.zeros(len(part.known), dtype=bool)
    whole = n - n % 32

    def least(score):
        """No more than the k-th largest score: that of blocks' maxima."""
        top = score[:whole].reshape(-1, 32).max(axis=1) if whole >= 64 * k else score
        return np.partition(top, -k)[-k] if len(top) > k else 0.0

    def exact(at, idf, found):
        met, doc = _runs(part.start[found], part.sizes[found]), np.repeat(np.arange(len(found)), part.sizes[found])
        place = np.minimum(np.searchsorted(at, part.word[met]), len(at) - 1)
        shared = np.flatnonzero(at[place] == part.word[met])
        doc, tf, idf = doc[shared], part.tfs[met[shared]], idf[place[shared]]
        return np.bincount(doc, idf * tf * (K1 + 1) / (tf + norm[found[doc]]), minlength=len(found))

    def run(queries):
        for start in range(0, len(queries), TOGETHER):
            words = []
            asked = np.zeros((min(TOGETHER, len(queries) - start), len(often)), dtype=np.float32)
            for row, (_, codes, idf) in enumerate(queries[start : start + TOGETHER]):
                here, at = part.words(codes)
                words.append((at, idf[here]))
                in_matrix = column[at] >= 0
                asked[row, column[at[in_matrix]]] = idf[here][in_matrix]
            common = asked @ dense
            for row, (at, idf) in enumerate(words):
                if not len(at):
                    yield at, idf
                    continue
                rare = column[at] < 0
                for w, x in zip(at[rare & ~weighed[at]].tolist(), idf[rare & ~weighed[at]].tolist(), strict=True):
                    weight[first[w] : last[w]] *= x
                    weighed[w] = True
                score = common[row].astype(np.float64)
                if rare.any():
                    spans = [(first[w], last[w]) for w in at[rare].tolist()]
                    score += np.bincount(np.concatenate([part.doc[a:b] for a, b in spans]), np.concatenate([weight[a:b] for a, b in spans]), minlength=n)
                if not itself:
                    score[part.plain == queries[start + row][0]] = 0.0
                slack = TIE + ERROR * (asked[row] @ most)
                found = np.flatnonzero(score >= least(score) - 2 * slack)
                found = found[score[found] > 0]
                if len(found) > k:
                    found = found[score[found] >= np.partition(score[found], -k)[-k] - 2 * slack]
                yield part.k_least(found, exact(at, idf, found), k)

    return part, run


def _sharing(least: int):
    """As _scored: the documents with `least` words of a query or more that may have the k largest values."""

    def made(docs: list, k: int, itself: bool):
        part = _Part(docs)

        def run(queries):
            for query, codes, _ in queries:
                at = part.words(codes)[1]
                n = np.bincount(part.doc[_runs(part.first[at], part.size[at])], minlength=len(part.ids))
                found = np.flatnonzero(n >= least)
                if not itself:
                    found = found[part.plain[found] != query]
                yield part.k_least(found, part.value[found], k)

        return part, run

    return made


def _parts_best(make, k: int, itself: bool):
    """Tasks of _meet(): rows sorted by part, its documents before the queries."""
    import pyarrow as pa

    def run(batches):
        part, docs, held = object(), [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            own, asked = batch.column("part").to_numpy(), batch.column("asked").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (asked[1:] != asked[:-1])])
            for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                rows = batch.slice(start, end - start)
                if own[start] != part:
                    part, docs, held = own[start], [], None
                if not asked[start]:
                    docs.append(rows)
                elif docs:
                    if held is None:
                        held, docs = make(docs, k, itself), [None]
                    there, best = held
                    queries = []
                    for query, codes, weights in zip(rows.column("query_id").to_pylist(), rows.column("codes"), rows.column("weights"), strict=True):
                        codes, weights = codes.values.to_numpy(), weights.values.to_numpy()
                        order = np.argsort(codes)
                        queries.append((query, codes[order], weights[order]))
                    found = list(best(queries))
                    q = np.repeat(np.arange(len(found)), [len(d) for d, _ in found])
                    d, x = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                    yield pa.RecordBatch.from_arrays([rows.column("query_id").take(pa.array(q)), there.ids.take(pa.array(d.astype(np.int64))), pa.array(x.astype(np.float64))], names=["query_id", "id", "score"])

    return run


def _meet(docs: DataFrame, asked: DataFrame, postings: int, make, k: int, itself: bool) -> DataFrame:
    """query_id, id, score that make() leaves of documents (id, codes, weights, value) and queries (query_id, code, weight): parts of POSTINGS, each of which meets all queries in numpy."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    parts = max(1, -(-postings // min(POSTINGS, max(FEWEST, postings // SPREAD))))
    queries = asked.groupBy("query_id").agg(F.collect_list(F.struct("code", "weight")).alias("t"))
    kind = {"id": docs.schema["id"].dataType, "query_id": asked.schema["query_id"].dataType}
    rows = docs.where("id IS NOT NULL").select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(False).alias("asked"), "id", F.lit(None).cast(kind["query_id"]).alias("query_id"), "codes", "weights", "value")
    rows = rows.unionByName(queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("asked"), F.lit(None).cast(kind["id"]).alias("id"), "query_id", F.col("t.code").alias("codes"), F.col("t.weight").alias("weights"), F.lit(0.0).alias("value")))
    schema = StructType([StructField("query_id", kind["query_id"]), StructField("id", kind["id"]), StructField("score", DoubleType())])
    return rows.repartition(parts, "part").sortWithinPartitions("part", "asked").mapInArrow(_parts_best(make, k, itself), schema)


def _counted(batches):
    import pyarrow as pa

    for batch in batches:
        code, n = np.unique(batch.column("codes").flatten().to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])


def best(lists: DataFrame, asked: DataFrame, k: int, itself: bool = True) -> DataFrame:
    """query_id, id, score of the documents that share a word with a query (query_id, code) and may be among its k best by BM25, the least id first among ties.

    lists is word_lists() of all documents. What a part hands on is to be
    ranked by top(). itself: a document may answer its own query.
    """
    n_docs, mean, postings = lists.agg(F.count("*"), F.avg("length"), F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()
    df = lists.select("codes").mapInArrow(_counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("df"))
    weighed = asked.distinct().join(df, "code").withColumn("weight", F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    norm = K1 * (1 - B + B * F.col("length") / F.lit(mean))
    return _meet(lists.select("id", "codes", F.col("tfs").alias("weights"), norm.alias("value")), weighed, postings, _scored, k, itself)


def bm25(docs_terms: DataFrame, queries: DataFrame, k: int, itself: bool = True) -> DataFrame:
    """best() for terms() of all documents, stored, and queries (query_id, term)."""
    code = cut(docs_terms.select("term").distinct().withColumn("code", F.monotonically_increasing_id()), "codes")
    pairs = docs_terms.join(code, "term").groupBy("id").agg(F.collect_list(F.struct("code", F.col("tf").cast("double").alias("tf"))).alias("t"), F.sum("tf").alias("length"))
    lists = cut(pairs.select("id", F.col("length").cast("double").alias("length"), F.col("t.code").alias("codes"), F.col("t.tf").alias("tfs")), "words")
    return best(lists, queries.join(code, "term").select("query_id", "code"), k, itself)


def sharing(lists: DataFrame, asked: DataFrame, least: int, k: int) -> DataFrame:
    """query_id, id, score of other documents with `least` words of a query (query_id, code) or more that may have its k largest values, the least id first among ties. lists: word_lists() with `value`, the score."""
    postings = lists.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()[0]
    return _meet(lists.select("id", "codes", F.col("tfs").alias("weights"), F.col("value").cast("double").alias("value")), asked.distinct().withColumn("weight", F.lit(1.0)), postings, _sharing(least), k, False)


def top(scored: DataFrame, by: list[str], score: str, k: int, name: str = "rank", tie: str = "id") -> DataFrame:
    """The k best rows of each group with their rank from 1; scores that are equal to 6 places are ties, the least `tie` first."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.round(score, 6)), tie)
    return scored.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def plan_score(similarity: Column) -> Column:
    return similarity * F.abs("valence") * F.greatest("strength", F.lit(0.1))


def plan_scores(similar: DataFrame, lexical: DataFrame, plans: DataFrame, min_valence: float, k: int, limit: int) -> DataFrame:
    """query_id, id, similarity, score of the plans each query recalls.

    similar: query_id, id, score (the k nearest count); lexical: query_id, id
    of plans that share an identifier or two keywords and count as similarity
    1 (those among a query's `limit` best by that are enough). plans: id, valence, strength; plans without a valence are left out.
    """
    near = top(similar, ["query_id"], "score", k).select("query_id", "id", F.col("score").alias("similarity"))
    every = near.unionByName(lexical.select("query_id", "id", F.lit(1.0).alias("similarity"))).groupBy("query_id", "id").agg(F.max("similarity").alias("similarity"))
    good = every.join(plans.where(F.col("valence") >= min_valence), "id")
    return top(good.withColumn("score", plan_score(F.col("similarity"))), ["query_id"], "score", limit).select("query_id", "id", "similarity", "score", "rank")


def plan_feedback(similar: DataFrame, plans: DataFrame, floor: float, least: float = 0.5, most: int = 5) -> DataFrame:
    """query_id, kind (warning or suggestion), id, impact: near plans that went badly or well, the strongest of each kind. similar: query_id, id, score."""
    near = similar.where(F.col("score") > floor).join(plans, "id")
    kind = F.when(F.col("valence") < -least, "warning").when(F.col("valence") > least, "suggestion")
    rated = near.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("impact", F.abs(F.col("valence") * F.col("score")))
    return top(rated, ["query_id", "kind"], "impact", most).select("query_id", "kind", "id", "impact", "rank")


def bundle(stages: list[DataFrame], budget: int) -> DataFrame:
    """query_id, stage, position, id, tokens, used: what fits a context bundle.

    stages, in order: query_id, id, rank, tokens. A node belongs to the first
    stage that has it; entries are taken while the running sum of tokens stays
    within the budget.
    """
    every = None
    for k, s in enumerate(stages):
        part = s.select("query_id", "id", F.lit(k).alias("stage"), "rank", "tokens")
        every = part if every is None else every.unionByName(part)
    first = Window.partitionBy("query_id", "id").orderBy("stage", "rank")
    once = every.withColumn("seen", F.row_number().over(first)).where("seen = 1").drop("seen")
    w = Window.partitionBy("query_id").orderBy("stage", "rank", "id")
    placed = once.withColumn("position", F.row_number().over(w)).withColumn("used", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.where(F.col("used") <= budget).select("query_id", "stage", "position", "id", "tokens", "used")


def route(sessions: DataFrame, scored: DataFrame, repos: DataFrame) -> DataFrame:
    """session_id, quest_id, confidence, method, state.

    A session whose repository a quest has is bound by it; else the best
    similarity with the workspace boost decides: bound, to be disambiguated,
    or a new quest. sessions: session_id, repo, workspace; scored: session_id,
    quest_id, score, workspace (of the quest); repos: repo, quest_id.
    """
    by_repo = repos.groupBy("repo").agg(F.min("quest_id").alias("repo_quest"))
    joined = scored.withColumnRenamed("workspace", "quest_workspace").join(sessions, "session_id")
    boosted = F.least(F.lit(1.0), F.col("score") + F.when(F.col("workspace") == F.col("quest_workspace"), WORKSPACE_BOOST).otherwise(0.0))
    best = top(joined.withColumn("boosted", boosted), ["session_id"], "boosted", 1, tie="quest_id").select("session_id", "quest_id", "boosted")
    every = sessions.join(by_repo, "repo", "left").join(best, "session_id", "left")
    git = F.col("repo_quest").isNotNull()
    score = F.round("boosted", 6)
    method = F.when(git, "git").when(score >= AUTO_BIND, "semantic").when(score >= ESCALATE, "disambiguate").otherwise("new_quest")
    state = F.when(git, "locked").when(score >= ESCALATE, "tentative").otherwise("new")
    quest = F.when(git, F.col("repo_quest")).when(score >= ESCALATE, F.col("quest_id"))
    return every.select("session_id", quest.alias("quest_id"), F.when(git, GIT_MATCH).otherwise(F.coalesce(score, F.lit(0.0))).alias("confidence"), method.alias("method"), state.alias("state"))


def routing_strength(messages: DataFrame, above: float = 0.70, boost: float = 0.10, consolidated: float = 0.85) -> DataFrame:
    """session_id, confidence, state after all messages (session_id, start, similarity): each one over `above` adds boost, 1 at most.

    Boosts only add, so the cap commutes with their order and a sum is enough.
    """
    g = messages.groupBy("session_id").agg(F.min("start").alias("start"), F.count_if(F.col("similarity") > above).alias("n"))
    sure = F.round(F.least(F.lit(1.0), F.col("start") + boost * F.col("n")), 6)
    return g.select("session_id", sure.alias("confidence"), F.when(sure >= consolidated, "consolidated").otherwise("tentative").alias("state"))


def action_gate(near: DataFrame, falsified: int = 3) -> DataFrame:
    """query_id, contradictions, supporting, decision, confidence from the procedures nearest each action. near: query_id, archetype, success_rate."""
    bad = F.count_if((F.col("archetype") == "avoidance") | (F.coalesce("success_rate", F.lit(0.0)) < 0.4)).alias("contradictions")
    good = F.count_if((F.col("archetype") != "avoidance") & (F.coalesce("success_rate", F.lit(0.0)) > 0.6)).alias("supporting")
    g = near.groupBy("query_id").agg(bad, good)
    stop, go = F.col("contradictions") >= falsified, F.col("supporting") > F.col("contradictions")
    sure = F.when(stop, F.least(F.lit(1.0), F.col("contradictions") * 0.2)).when(go, F.least(F.lit(1.0), F.col("supporting") * 0.15 + 0.3)).otherwise(0.5)
    return g.select("query_id", "contradictions", "supporting", F.when(stop, "no_go").when(go, "go").otherwise("explore").alias("decision"), F.round(sure, 6).alias("confidence"))


def explore_or_exploit(actions: DataFrame, recent: int = 5, stale: int = 3, error: float = -0.3) -> DataFrame:
    """context, explore, staleness: the last `stale` actions are one and the same, or three of the `recent` ones went worse than expected. actions: context, at, action, error."""
    w = Window.partitionBy("context").orderBy(F.desc("at"))
    last = actions.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= recent)
    g = last.groupBy("context").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("rn") <= stale, F.col("action"))).alias("kinds"), F.count_if(F.col("error") < error).alias("bad"))
    same = (F.col("n") >= stale) & (F.col("kinds") == 1)
    return g.select("context", (same | (F.col("bad") >= 3)).alias("explore"), F.when(same, 1.0).when(F.col("bad") >= 3, F.col("bad") / 5.0).otherwise(0.0).alias("staleness"))


def satisfiable(candidates: DataFrame, requires: DataFrame, superseded: DataFrame) -> DataFrame:
    """candidates (id, ...) with requires_satisfiable: nothing they require (id, needs) is superseded (needs)."""
    broken = requires.join(superseded, "needs", "left_semi").select("id").distinct().withColumn("broken", F.lit(True))
    return candidates.join(broken, "id", "left").withColumn("requires_satisfiable", F.col("broken").isNull()).drop("broken")


def without_distinct(pairs: DataFrame, distinct_from: DataFrame) -> DataFrame:
    """Pairs (a, b) that no DISTINCT_FROM edge (src, dst), whichever way, keeps apart."""
    e = distinct_from.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.join(e, ["a", "b"], "left_anti")


def triggers(messages: DataFrame, near: DataFrame, signal: Column, floor: float, most: int = 3) -> DataFrame:
    """Bindings of the messages that carry a signal to their nearest lessons: id, bound, score, rank. near: id, bound, score."""
    return top(near.join(messages.where(signal).select("id"), "id", "left_semi").where(F.col("score") >= floor), ["id"], "score", most, tie="bound")
