"""Tabular and document sources: files to frames, profiles, read-only SQL over one dataset, a graph dump."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.sources import guard

MIN_CHUNK, MAX_CHUNK = 80, 2000
#: Chunks are handed to Spark after so many characters of text.
OUT_CHARS = 1 << 20
_BREAK = re.compile(r"\n{2,}|\n(?=#{1,6} )")
_SENTENCE = re.compile(r"[.!?]\s")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV, TSV or JSON array by its extension; a header and inferred types for the first two."""
    if path.endswith(".json"):
        return spark.read.option("multiLine", True).json(path)
    return spark.read.option("header", True).option("inferSchema", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(path)


def query(data: DataFrame, sql: str, args: dict | None = None) -> DataFrame:
    """A SELECT over the one table `data`; what is no query, or reads another table, path, file or the JVM, is refused.

    Names are resolved scope by scope (see guard). A view that the caller has
    under that name is neither read nor replaced, and none is left behind.
    args bind the markers (:name) of the text.
    """
    return read_only(data.sparkSession, sql, {"data": data}, args)


def read_only(spark: SparkSession, sql: str, tables: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
    """As query(), over several named tables."""
    guard.check(spark, f"SELECT * FROM (\n{sql}\n) AS asked", set(tables))  # a subquery: no command can stand there
    views = {name: f"dataset_{uuid.uuid4().hex}" for name in tables}
    for name, view in views.items():
        tables[name].createOrReplaceTempView(view)
    try:
        named = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in views.items())
        return spark.sql(f"WITH {named} SELECT * FROM (\n{sql}\n) AS asked", args)
    finally:  # the plan is resolved by now and needs no view
        for view in views.values():
            spark.catalog.dropTempView(view)


def profile(data: DataFrame) -> DataFrame:
    """column, dtype, null_count and total of each column, in one pass."""
    counts = [F.count_if(F.col(c).isNull()).alias(c) for c in data.columns]
    row = data.agg(F.count("*").alias("all_rows"), F.struct(*counts).alias("nulls"))
    parts = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"nulls.{c}").alias("null_count"), F.col("all_rows").alias("total")) for c, t in data.dtypes]
    return row.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def save_dataset(data: DataFrame, path: str) -> None:
    """The one table of a dataset; an older one is replaced."""
    data.write.mode("overwrite").parquet(path)


def summary(spark: SparkSession, path: str, sample_rows: int = 5) -> tuple[list[tuple[str, str]], int, list]:
    """Columns with their types, the number of rows and the first few of them."""
    data = spark.read.parquet(path)
    return data.dtypes, data.count(), data.limit(sample_rows).collect()


def drop_dataset(spark: SparkSession, path: str) -> bool:
    """Whether there was a dataset to drop."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_dump(nodes: dict[str, DataFrame], path: str) -> DataFrame:
    """JSON lines of every node or edge table under path; the manifest (table, rows) comes back and is written beside them."""
    for name, df in nodes.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    counts = [df.agg(F.lit(name).alias("table"), F.count("*").alias("rows")) for name, df in nodes.items()]
    manifest = reduce(DataFrame.unionByName, counts)
    manifest.write.mode("overwrite").json(f"{path}/_manifest.d")
    return manifest


def read_edges(spark: SparkSession, path: str, schema: str, nodes: DataFrame) -> DataFrame:
    """Edges of a dump of which both ends are among the nodes (node)."""
    e = spark.read.schema(schema).json(path)
    known = nodes.select("node")
    return e.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")


def chunk(text: str) -> list[tuple[int, int]]:
    """Character spans: paragraphs and headings, short ones joined to the next, long ones cut at sentence ends (else spaces)."""
    cuts = [0, *(m.end() for m in _BREAK.finditer(text)), len(text)]
    parts = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if text[a:b].strip()]
    joined: list[tuple[int, int]] = []
    for a, b in parts:
        if joined and len(text[slice(*joined[-1])].strip()) < MIN_CHUNK:
            joined[-1] = (joined[-1][0], b)
        else:
            joined.append((a, b))
    out = []
    for a, b in joined:
        while b - a > MAX_CHUNK:
            window = text[a : a + MAX_CHUNK]
            ends = [m.end() for m in _SENTENCE.finditer(window)]
            at = a + (ends[-1] if ends else max(window.rfind(" "), 0) or MAX_CHUNK)
            out.append((a, at))
            a = at
        out.append((a, b))
    trimmed = [(a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())) for a, b in out if text[a:b].strip()]
    return trimmed


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, number, begin, end, text of every chunk; null and blank texts have none. Rows without an id keep their chunks."""
    names = ["doc_id", "number", "begin", "end", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for i, t in zip(batch.doc_id, batch.text, strict=True):
                rows += [(i, k, a, b, t[a:b]) for k, (a, b) in enumerate(chunk(t))]
                held += len(t)
                if held > OUT_CHARS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    ids = F.col("doc_id").cast("long").cast("string").alias("doc_id")  # whole numbers beside nulls reach pandas as doubles
    cut = docs.where("text IS NOT NULL").select(ids, "text").mapInPandas(run, "doc_id string, number int, begin int, end int, text string")
    return cut.withColumn("doc_id", F.col("doc_id").cast("long"))


def html_text(html):
    """The text of a page as a column: scripts, styles and tags out, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))
