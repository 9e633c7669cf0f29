"""Queries of ingestion: dataset SQL, profiles, pages, chunks and the stream of turns, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mnemospark.sources import tabular
from mnemospark.sources.memory_tables import edges, table
from mnemospark.storage import shared_root
from mnemospark.streaming import turns

#: Any SELECT over a dataset: the view is `data`.
_DATASET = {
    "dataset_group": ("orders", "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM data GROUP BY o_orderstatus"),
    "dataset_window": ("orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM data"),
    "dataset_join": ("orders", "SELECT a.o_orderkey AS a, count(*) AS n FROM data a JOIN data b ON a.o_custkey = b.o_custkey AND b.o_totalprice > a.o_totalprice GROUP BY a.o_orderkey"),
    "dataset_setop": ("lineitem", "SELECT l_suppkey, l_returnflag FROM data WHERE l_quantity > 45 INTERSECT SELECT l_suppkey, l_returnflag FROM data WHERE l_quantity < 3"),
    "dataset_except": ("lineitem", "SELECT l_partkey FROM data EXCEPT SELECT l_partkey FROM data WHERE l_quantity > 48"),
    "dataset_cte": ("customer", "WITH m AS (SELECT c_nationkey, max(c_acctbal) AS most FROM data GROUP BY c_nationkey) SELECT c_custkey, m.most FROM data JOIN m ON data.c_nationkey = m.c_nationkey AND c_acctbal = most"),
    "dataset_rollup": ("lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM data GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
}


def _dataset(name: str, source: str, sql: str):
    def run(spark, sf_dir):
        return tabular.query(table(spark, sf_dir, source), sql)

    run.__name__ = name
    return run


def ingest_profile(spark, sf_dir):
    return tabular.profile(table(spark, sf_dir, "documents")).select("column", "null_count", "total")


def ingest_html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(tabular.html_text(F.coalesce("html", F.lit(""))), 256).alias("text_sha256"))


def ingest_chunks(spark, sf_dir):
    """Rows only: cut by a small helper in Python, which the tests hold to its rules."""
    return tabular.chunks(table(spark, sf_dir, "documents"))


def ingest_graph_dump(spark, sf_dir):
    """Written as JSON lines and read back: edges by type, of which both ends are customers or orders."""
    e = edges(spark, sf_dir)
    path = f"{shared_root(spark)}/mnemospark/dump-{uuid.uuid4().hex}"
    ends = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().where("node LIKE 'c%' OR node LIKE 'o%'")
    tabular.write_dump({"nodes": ends, "edges": e}, path)
    back = tabular.read_edges(spark, f"{path}/edges", "src string, dst string, rel_type string, confidence double", spark.read.schema("node string").json(f"{path}/nodes"))
    return back.groupBy("rel_type").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


def stream_turns(spark, sf_dir):
    """The turns as a stream, twice over: the second run finds nothing new."""
    source = f"{sf_dir}/conversations.parquet"
    schema = spark.read.parquet(source).schema
    root = f"{shared_root(spark)}/mnemospark/turns-{uuid.uuid4().hex}"
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(f"{source}*")  # a pattern, as the table may be a file or a folder
        turns.ingest(stream.withColumnRenamed("conv_id", "session_id"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.groupBy("role").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


QUERIES = {name: _dataset(name, *x) for name, x in _DATASET.items()} | {f.__name__: f for f in (ingest_profile, ingest_html_text, ingest_chunks, ingest_graph_dump, stream_turns)}

ORACLE_SQL = {name: sql.replace("FROM data", f"FROM {source} AS data").replace("AS data a ", "a ").replace("JOIN data b", f"JOIN {source} b") for name, (source, sql) in _DATASET.items()} | {
    "ingest_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS null_count, count(*) AS total FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")),
    "ingest_html_text": r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_sha256 FROM pages""",
    "ingest_graph_dump": """SELECT 'INVOKES' AS rel_type, count(*) AS n, round(sum(CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey % 10 / 10.0 END), 4)::DOUBLE AS confidence FROM orders
  WHERE o_custkey IN (SELECT c_custkey FROM customer) OR o_custkey IN (SELECT o_custkey FROM orders)""",
    "stream_turns": """SELECT role, count(*) AS n, CAST(sum(length(CASE WHEN length(t) <= 4000 THEN t WHEN regexp_extract(substr(t, 1, 4000), '(?s)^(.*[.!?])\\s', 1) <> '' THEN regexp_extract(substr(t, 1, 4000), '(?s)^(.*[.!?])\\s', 1)
  WHEN regexp_extract(substr(t, 1, 4000), '(?s)^(.*\\S)\\s', 1) <> '' THEN regexp_extract(substr(t, 1, 4000), '(?s)^(.*\\S)\\s', 1) ELSE substr(t, 1, 4000) END) // 3) AS BIGINT) AS tokens FROM (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS t FROM conversations) GROUP BY role""",
}
