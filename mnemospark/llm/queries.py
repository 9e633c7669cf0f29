"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemospark.llm._common import documents


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemospark.llm.exact_dedup import exact_duplicates

    return exact_duplicates(documents(spark, sf_dir))


def op1_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemospark.llm.mpegts import digest, store

    return digest(store(documents(spark, sf_dir)))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemospark.llm.minhash import link_components

    return link_components(documents(spark, sf_dir), words=3, threshold=(85, 100))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemospark.llm.sharding import shard_documents

    return shard_documents(documents(spark, sf_dir), shards=8)


def word_bpe() -> str:
    """The place of the vocabulary that the queries use; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemospark.llm.packing import pack

    return pack(documents(spark, sf_dir), word_bpe())


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemospark.llm.suffix_dedup import repeated_spans

    return repeated_spans(documents(spark, sf_dir)).drop("doc")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemospark.llm.bpe import round_trip

    return round_trip(documents(spark, sf_dir), word_bpe())


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemospark.llm.token_shards import training_order

    return training_order(documents(spark, sf_dir), word_bpe(), key=20240607)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemospark.llm.warc import archive_pages

    records = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), least_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_lang_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemospark.llm.lang_ppm import identify

    return identify(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemospark.llm.collocations import collocations

    return collocations(documents(spark, sf_dir), least=30, top=2000, contained=80)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemospark.llm.divergence import divergence

    return divergence(documents(spark, sf_dir), least_docs=30, smoothing=5, top=50)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemospark.llm.simhash import link_components

    return link_components(documents(spark, sf_dir), words=4, distance=4)


QUERIES = {
    "op1_mpegts": op1_mpegts,
    "op2_minhash": op2_minhash,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_bpe": op6_bpe,
    "op7_token_shards": op7_token_shards,
    "op8_warc": op8_warc,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_lang_ppm": op10_lang_ppm,
    "op11_collocations": op11_collocations,
    "op12_divergence": op12_divergence,
    "op13_simhash": op13_simhash,
}

ORACLE_SQL = {
    "op8_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST(list_sum(list_transform(range(5), lambda b:
           ((strpos('0123456789abcdef', substr(hex, 1 + CAST((5 * k + b) // 4 AS INTEGER), 1)) - 1)
             // CAST(pow(2, 3 - (5 * k + b) % 4) AS BIGINT)) % 2 * CAST(pow(2, 4 - b) AS BIGINT))) AS INTEGER), 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
""",
    "op9_exact_dedup": """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
""",
    "op11_collocations": r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, range(1, 5) r(k) WHERE len(ws) >= k
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY lang, k, phrase
), c AS (
  SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND n >= 30
), x AS MATERIALIZED (
  SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail FROM c, range(1, 4) x(j) WHERE j < k
), h AS MATERIALIZED (
  SELECT x.*, f.n AS l FROM x JOIN f ON f.lang = x.lang AND f.phrase = x.head
), s AS (
  SELECT h.lang, h.phrase, a, j, l, f.n AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (l + f.n) AS BIGINT) AS score
  FROM h JOIN f ON f.lang = h.lang AND f.phrase = h.tail
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), y AS (
  SELECT lang, phrase, max(longer) AS longer FROM (
    SELECT c.lang, c.a AS longer, array_to_string(c.ws[i:i + m - 1], ' ') AS phrase
    FROM c, range(2, 4) x(m), range(1, 4) z(i) WHERE m < c.k AND i + m - 1 <= c.k) GROUP BY lang, phrase
), k AS (
  SELECT b.* FROM b LEFT JOIN y ON y.lang = b.lang AND y.phrase = b.phrase WHERE y.longer IS NULL OR 100 * y.longer < 80 * b.a
), n AS (
  SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score
FROM k JOIN n USING (lang) QUALIFY rank <= 2000
""",
    "op12_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), o AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS lang_n FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 30
), c AS (
  SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY lang, source, term
), g AS (
  SELECT lang, source FROM d GROUP BY lang, source
), s AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n,
         sum(coalesce(c.n, 0)) OVER w + 5 * count(*) OVER w AS whole, sum(k.lang_n) OVER w + 5 * count(*) OVER w AS lang_whole
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  WINDOW w AS (PARTITION BY g.lang, g.source)
), p AS (
  SELECT lang, source, term, n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // whole AS BIGINT) AS p,
         CAST(1 + (CAST(1000000000 AS HUGEINT) * (lang_n + 5)) // lang_whole AS BIGINT) AS q FROM s
), pairs AS (
  SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
), v AS (
  SELECT x.lang, x.source, 'pair' AS part, x.item, CAST(coalesce(sum(abs(a.p - b.p)), 0) AS BIGINT) AS value
  FROM pairs x LEFT JOIN p a ON a.lang = x.lang AND a.source = x.source LEFT JOIN p b ON b.lang = x.lang AND b.source = x.item AND b.term = a.term
  GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM v
)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
""",
}
