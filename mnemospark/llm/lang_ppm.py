"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of orders 0 to MAX_ORDER with escape
probabilities (method C): in a context seen T times with q distinct next
bytes, a byte seen n times costs -log2(n / (T + q)), and any other byte costs
an escape of -log2(q / (T + q)) and then what it costs in the context without
its first byte; below order 0 a byte costs 8 bits. Statistics are frozen after
training, so the cost of every gram seen in any language is computed once for
all languages, and scoring is one table lookup a byte: the longest gram known
anywhere gives the exact code lengths of all languages, and only bytes of
grams unknown everywhere escape to the next shorter table. Costs are integers
of 2**-16 bits, so sums do not depend on order.

What is scored is the text in lower case with each run of ASCII characters
other than letters as one space: digits and punctuation tell nothing about the
language, and a spell of them would drown what the letters say.

The trees are fitted on a sample of labelled rows of at most about
TRAIN_BYTES a language; everything else reads every whole text. Every
labelled language is learned: longer rows are cut into pieces where the short
ones do not fill the sample, and languages past GROUP_LANGUAGES go to further
tables, which are scored one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm._common import bound_batches, materialise, trimmed

MAX_ORDER = 4
#: The sample bound: bytes of training text a language. A piece of training text is an eighth of it at most.
TRAIN_BYTES = 512 << 10
#: Languages that share one set of tables; no language is left out.
GROUP_LANGUAGES = 256
#: A text is in no learned language if its best model needs this many bits more than plain bytes would: odds of 2**64.
REJECT_EXCESS = 64
UNIT = 1 << 16
_LETTER = regex.compile(r"\p{L}")
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ONLY_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
GROUP_BYTES = 1 << 20


class GramTable:
    """Open-addressed table: gram key -> row of costs (one column a language)."""

    def __init__(self, keys: np.ndarray, costs: np.ndarray):
        bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.row, self.costs = np.full(1 << bits, _EMPTY), np.zeros(1 << bits, np.int32), costs
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == _EMPTY
            _, one = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[one]
            self.keys[slot[won]], self.row[slot[won]] = keys[left[won]], left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, slot = left[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        slot = self._slot(keys)
        held = self.keys[slot]
        found = np.where(held == keys, self.row[slot], -1)
        again = np.flatnonzero((held != keys) & (held != _EMPTY))
        slot = slot[again]
        while len(again):
            slot = (slot + 1) & self.mask
            held = self.keys[slot]
            hit = held == keys[again]
            found[again[hit]] = self.row[slot[hit]]
            on = ~hit & (held != _EMPTY)
            again, slot = again[on], slot[on]
        return found


def gram_keys(data: np.ndarray, order: int) -> np.ndarray:
    """Keys of the grams of order+1 bytes that end at each position from MAX_ORDER on."""
    keys = np.zeros(len(data) - MAX_ORDER, np.uint64)
    for back in range(order, -1, -1):
        keys = keys << np.uint64(8) | data[MAX_ORDER - back : len(data) - back]
    return keys


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one array, each after MAX_ORDER spaces, and the positions of texts' own bytes less MAX_ORDER."""
    lead = b" " * MAX_ORDER
    data = np.frombuffer(b"".join(x for t in texts for x in (lead, t)), np.uint8).astype(np.uint64)
    ends = np.cumsum([len(t) + MAX_ORDER for t in texts])
    own = np.ones(len(data), bool)
    starts = ends - np.array([len(t) + MAX_ORDER for t in texts])
    own[(starts[:, None] + np.arange(MAX_ORDER)).ravel()] = False
    return data, np.flatnonzero(own[MAX_ORDER:])


def folded(text: str) -> bytes:
    """Lower-case UTF-8 with runs of ASCII non-letters as one space."""
    return b" ".join(text.lower().encode().translate(_ONLY_LETTERS).split())


class PpmModel:
    """Frozen context trees of all languages. counts: a frame of lang (index), ord, key, n."""

    def __init__(self, langs: list[str], counts: pd.DataFrame):
        self.langs, width = langs, len(langs)
        self.parts: list[PpmModel] = []
        self.grams: list[GramTable] = []
        self.escapes: list[GramTable] = []
        below_keys, below = np.zeros(0, np.uint64), np.zeros((0, width))
        for order in range(MAX_ORDER + 1):
            part = counts[counts.ord == order]
            keys, at = np.unique(part.key.to_numpy().astype(np.uint64), return_inverse=True)
            n = np.zeros((len(keys), width))
            n[at, part.lang.to_numpy()] = part.n.to_numpy()
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
            np.add.at(total, of, n)
            np.add.at(kinds, of, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                direct = -np.log2(n / (total + kinds)[of])
            if order:
                shorter = below[np.searchsorted(below_keys, keys & np.uint64((1 << 8 * order) - 1))]
            else:
                shorter = np.full((len(keys), width), 8.0)
            costs = np.where(n > 0, direct, escape[of] + shorter)
            self.grams.append(GramTable(keys, np.rint(costs * UNIT).astype(np.int32)))
            self.escapes.append(GramTable(contexts, np.rint(escape * UNIT).astype(np.int32)))
            below_keys, below = keys, costs

    @classmethod
    def joined(cls, parts: list[PpmModel]) -> PpmModel:
        """One model of the languages of all parts, in their order. A language's code lengths do not depend on others."""
        out = cls([], pd.DataFrame({"lang": [], "ord": [], "key": [], "n": []}, dtype="int64"))
        out.langs, out.parts = [lang for p in parts for lang in p.langs], parts
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language, in 2**-16 bits."""
        if self.parts:
            return np.hstack([p.lengths(texts) for p in self.parts])
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        full = [i for i, t in enumerate(texts) if t]
        if not full or not self.langs:
            return out
        data, left = padded([texts[i] for i in full])
        sizes = np.array([len(texts[i]) for i in full])
        doc = np.repeat(np.arange(len(full)), sizes)
        for order in range(MAX_ORDER, -1, -1):
            keys = gram_keys(data, order)[left]
            row = self.grams[order].find(keys)
            self._add(out, full, doc, row, self.grams[order].costs)
            lost = row < 0
            left, doc, keys = left[lost], doc[lost], keys[lost]
            if not len(left):
                return out
            self._add(out, full, doc, self.escapes[order].find(keys >> np.uint64(8)), self.escapes[order].costs)
        np.add.at(out, np.array(full)[doc], 8 * UNIT)
        return out

    @staticmethod
    def _add(out: np.ndarray, full: list[int], doc: np.ndarray, row: np.ndarray, costs: np.ndarray) -> None:
        known = row >= 0
        if not known.all():
            doc, row = doc[known], row[known]
        if len(doc):
            starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            for k in range(costs.shape[1]):
                out[np.array(full)[doc[starts]], k] += np.add.reduceat(costs[:, k][row], starts, dtype=np.int64)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, posterior under equal priors, bits a byte, rejected) of each text."""
        data = [folded(t) if t and _LETTER.search(t) else b"" for t in texts]
        bits = self.lengths(data) / UNIT
        out = []
        for i, t in enumerate(data):
            if not t or not self.langs:
                out.append(("und", 0.0, None, True))
                continue
            best = int(np.argmin(bits[i]))  # equal lengths: the first language in code-point order
            weight = np.exp2(np.maximum(bits[i, best] - bits[i], -1000.0)).sum()
            out.append((self.langs[best], float(1 / weight), float(bits[i, best] / len(t)), bool(bits[i, best] > 8 * len(t) + REJECT_EXCESS)))
        return out


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, part in batch.groupby("lang"):
            data, own = padded([folded(t) for t in part.text])
            for order in range(MAX_ORDER + 1):
                keys, n = np.unique(gram_keys(data, order)[own], return_counts=True)
                yield pd.DataFrame({"lang": lang, "ord": np.int32(order), "key": keys.astype(np.int64), "n": n.astype(np.int64)})


def _cut(chars: int):
    """Rows (lang, h, text) as pieces of so many characters: lang, h, piece, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, h, text in zip(batch.lang, batch.h, batch.text):
                pieces = [text[k : k + chars] for k in range(0, len(text), chars)]
                yield pd.DataFrame({"lang": lang, "h": h, "piece": range(len(pieces)), "text": pieces})

    return run


def _levels(units: DataFrame) -> dict[str, dict[int, int]]:
    """Bytes by language and level, equal units once: languages x 64 rows on the driver."""
    levels: dict[str, dict[int, int]] = {}
    for r in units.select("lang", "h", "size", "level").distinct().groupBy("lang", "level").agg(F.sum("size").alias("size")).collect():
        levels.setdefault(r["lang"], {})[r["level"]] = r["size"]
    return levels


def training_sample(docs: DataFrame, train_bytes: int, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], DataFrame | None]:
    """The languages in order, and their training text: lang (index), h, text."""
    spark, size, most = docs.sparkSession, F.octet_length("text"), max(1, train_bytes // 8)
    rows = docs.where(~held_out(id_col)).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & (size > 0))

    def units(frame: DataFrame) -> DataFrame:
        return frame.select("text", "lang", "h", size.alias("size"), (63 - F.length(F.bin(F.shiftrightunsigned("h", 1)))).alias("level"))

    short = rows.where(size <= most)
    levels, every = _levels(units(short)), units(short)
    long = rows.where(size > most)
    poor = [r["lang"] for r in long.select("lang").distinct().collect() if sum(levels.get(r["lang"], {}).values()) < train_bytes]
    if poor:
        wanted = F.broadcast(spark.createDataFrame([(x,) for x in poor], "lang string"))
        cut = long.join(wanted, "lang").select("lang", "h", "text").mapInPandas(trimmed(_cut(max(1, most // 4))), "lang string, h long, piece long, text string")
        pieces = units(cut.select("text", "lang", F.xxhash64("h", "piece").alias("h")))
        for lang, sizes in _levels(pieces).items():
            held = levels.setdefault(lang, {})
            for level, n in sizes.items():
                held[level] = held.get(level, 0) + n
        every = every.unionByName(pieces)
    chosen, over = {}, []
    for lang, sizes in levels.items():
        held, at = 0, None
        for level in sorted(sizes, reverse=True):
            held += sizes[level]
            if held > train_bytes:
                if at is None:
                    at = level
                    over.append(lang)
                break
            at = level
        chosen[lang] = at
    langs = sorted(chosen)
    if not langs:
        return [], None
    table = spark.createDataFrame([(x, i, chosen[x], x in over) for i, x in enumerate(langs)], "lang string, i int, at int, over boolean")
    sample = every.join(F.broadcast(table), "lang").where(F.col("level") >= F.col("at")).select(F.col("i").alias("lang"), "h", "text", "over").distinct()
    if over:  # the first level alone is over the bound: as many of its units, in order of the hash, as fit
        before = Window.partitionBy("lang").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, 0)
        first = sample.where("over").withColumn("held", F.sum(size).over(before)).where(F.col("held") <= max(train_bytes, 1)).drop("held")
        sample = sample.where("NOT over").unionByName(first)
    return langs, sample.drop("over")


def fit(docs: DataFrame, train_bytes: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> PpmModel:
    """Fit the trees on rows that are not held out and have a text and a language.

    The sample takes rows by the leading zero bits of a hash of id and text:
    for each language the least level whose rows hold at most train_bytes, and
    of a highest level that holds more as many rows as fit. Rows that are equal
    in id and text count once. Where a language's rows of train_bytes / 8 or
    less do not fill the sample, its longer rows join in as pieces of that size.
    Grams are counted on Spark; the model has at most MAX_ORDER + 1 grams for
    each sampled byte, which bounds what the driver and tasks hold for a
    language. Past GROUP_LANGUAGES languages, each group has its own tables.
    """
    bound_batches(docs.sparkSession)
    langs, sample = training_sample(docs, train_bytes, id_col, text_col, lang_col)
    if sample is None:
        return PpmModel([], pd.DataFrame({"lang": [], "ord": [], "key": [], "n": []}, dtype="int64"))
    few = sample.select("lang", "text").coalesce(len(langs))  # a language's bytes a task: else each of many tasks has most grams
    counted = few.mapInPandas(trimmed(_count), "lang int, ord int, key long, n long").groupBy("lang", "ord", "key").agg(F.sum("n").alias("n"))
    if len(langs) <= GROUP_LANGUAGES:
        return PpmModel(langs, counted.toPandas())
    counted = materialise(counted, "grams")
    parts = []
    for k in range(0, len(langs), GROUP_LANGUAGES):
        part = counted.where(F.col("lang").between(k, k + GROUP_LANGUAGES - 1)).withColumn("lang", F.col("lang") - k)
        parts.append(PpmModel(langs[k : k + GROUP_LANGUAGES], part.toPandas()))
    return PpmModel.joined(parts)


def predict(docs: DataFrame, model: PpmModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (default: the id) with lang_pred, score, bits_per_byte and rejected for each row.

    The language of a null or empty text, or one without a letter, is `und`
    with score 0, and it is rejected. Where no labelled row could be learned
    from, all are `und`. Repeated rows give repeated results.
    """
    keep = [id_col] if keep is None else keep
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[text_col].alias("text"))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        frozen = shared.value
        for texts in batches:
            rows: list[tuple] = []
            group: list[str | None] = []
            held = 0
            for t in texts:
                group.append(t)
                held += len(t or "")
                if held >= GROUP_BYTES:
                    rows += frozen.predict(group)
                    group, held = [], 0
            rows += frozen.predict(group)
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "bits_per_byte", "rejected"]).astype({"bits_per_byte": "float64"})

    guess = F.pandas_udf("lang_pred string, score double, bits_per_byte double, rejected boolean")(trimmed(run))
    out = schema.withColumn("guess", guess("text"))
    return out.select(*[F.col(f"row.{c}").alias(c) for c in keep], "guess.*")


def identify(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, bits_per_byte, rejected."""
    found = predict(docs, fit(docs, train_bytes))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "bits_per_byte", "rejected")


def keep_identified(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """docs without the rows in no learned language: `und`, or REJECT_EXCESS bits worse than plain bytes."""
    names = docs.columns
    inner = docs.select(F.struct(*[docs[c] for c in names]).alias("kept_row"), docs["doc_id"], docs["text"], docs["lang"])
    found = predict(inner, fit(docs, train_bytes), keep=["kept_row"])
    return found.where(~F.col("rejected")).select([F.col(f"kept_row.{c}").alias(c) for c in names])
