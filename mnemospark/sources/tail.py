"""Tailing of growing line files: each line once, with its byte offset, newest files first.

A scan lists the files (names, lengths and times only), reads what lies behind
the place reached in each, and commits the new lines and the new places in one
version: a scan that dies leaves neither. A line counts when it is ended; a
file that became shorter is read from its start.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.sources.versioned import Tables, Upsert
from mnemospark.storage import cut

#: Bytes read at a time; a longer line is put together from several.
BLOCK = 1 << 20
#: Lines of a file that is seen first: only so many of its last ones.
BACKFILL = 20
MOST_LINES = 100


def listing(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, length and changed_at of the files below a folder; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", F.unix_micros("modificationTime").alias("changed_at"))


def _blocks_back(file, end: int, lines: int) -> int:
    """Where the last `lines` ended lines before byte `end` begin."""
    at, held, seen = end, b"", 0
    while at > 0:
        low = max(0, at - BLOCK)
        file.seek(low)
        held = file.read(at - low)
        if at == end and not held.endswith(b"\n"):  # what is not ended yet doesn't count
            held = held[: held.rfind(b"\n") + 1]
        for k in range(len(held) - 1, -1, -1):
            if held[k] == 10:
                seen += 1
                if seen > lines:
                    return low + k + 1
        at = low
    return 0


def _read(most: int, backfill: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for path, start, end, fresh in zip(batch.path, batch.start.tolist(), batch.length.tolist(), batch.fresh, strict=True):
                store, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
                with store.open_input_file(name) as file:
                    at = max(start, _blocks_back(file, end, backfill)) if fresh and backfill is not None else start
                    file.seek(at)
                    held, n, rows = b"", 0, []
                    while n < most and file.tell() < end:
                        held += file.read(min(BLOCK, end - file.tell()))
                        while n < most and (stop := held.find(b"\n")) >= 0:
                            rows.append((path, n, at, at + stop + 1, held[:stop].decode(errors="replace")))
                            at, held, n = at + stop + 1, held[stop + 1 :], n + 1
                        if rows and len(rows) * 64 + sum(len(r[4]) for r in rows) > BLOCK:
                            yield pd.DataFrame(rows, columns=_LINES)
                            rows = []
                    yield pd.DataFrame(rows, columns=_LINES)

    return run


_LINES = ["path", "n", "at", "behind", "value"]


def scan(files: DataFrame, store: Tables, most: int = MOST_LINES, backfill: int | None = BACKFILL) -> int:
    """Take at most `most` new lines, newest files first (then by path); how many were taken.

    files: path, length, changed_at, as of listing(). The store's tables
    `lines` (path, at, value, scan) and `places` (path, reached) grow together.
    """
    places = store.read("places")
    if places is None:
        places = files.select("path", F.lit(0).cast("long").alias("reached")).limit(0)
    told = files.join(places, "path", "left").withColumn("fresh", F.col("reached").isNull())
    start = F.when(F.coalesce("reached", F.lit(0)) <= F.col("length"), F.coalesce("reached", F.lit(0))).otherwise(F.lit(0))
    grown = cut(told.withColumn("start", start.cast("long")).where((F.col("start") < F.col("length")) | (F.col("reached") > F.col("length"))), "grown")
    spread = grown.repartition(max(1, min(grown.count(), 10_000)), "path")
    lines = cut(spread.select("path", "start", "length", "fresh").mapInPandas(_read(most, backfill), "path string, n long, at long, behind long, value string"), "tail-lines")
    # The quota is shared out over files, a row each, before any line is looked at again.
    each = lines.groupBy("path").agg(F.count("*").alias("lines")).join(grown.select("path", "changed_at"), "path")
    before = F.coalesce(F.sum("lines").over(Window.orderBy(F.desc("changed_at"), "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = each.withColumn("quota", F.greatest(F.lit(0), F.lit(most) - before)).select("path", "quota")
    taken = cut(lines.join(quota, "path").where(F.col("n") < F.col("quota")), "tail-taken")
    version = store.version() + 1
    reached = taken.groupBy("path").agg(F.max("behind").alias("reached"))
    cut_off = grown.where(F.col("reached") > F.col("length")).select("path", F.lit(0).cast("long").alias("reached"))
    moved = reached.unionByName(cut_off.join(reached, "path", "left_anti"))
    # A line is its file, its place and its content: a file written anew may say something else at the same place.
    rows = taken.select("path", "at", "value", F.sha2("value", 256).alias("line"), F.lit(version).alias("scan"))
    old = store.read("lines")
    rows = rows if old is None else rows.join(old.select("path", "at", "line"), ["path", "at", "line"], "left_anti")
    return store.commit({"lines": Upsert(rows, ["path", "at", "line"]), "places": Upsert(moved, ["path"])})["lines"]["inserted"]


def drain(spark: SparkSession, folder: str, store: Tables, most: int = MOST_LINES, backfill: int | None = BACKFILL, pattern: str = "*.jsonl") -> int:
    """Scan until nothing is left; how many lines were taken."""
    total = 0
    while n := scan(listing(spark, folder, pattern), store, most, backfill):
        total += n
    return total
